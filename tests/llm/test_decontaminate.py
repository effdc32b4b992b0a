import pytest

from shopstar.llm import decontaminate as dc
from shopstar.llm import queries
from tests.llm.conftest import ODD, SF, doc_rows

ITEM = "Anna has 12 apples and Bert has 30 pears, so Anna gives Bert 12 apples and walks 5 km to the old market"


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(spark, text, *bench, **kw):
    rows = dc.find(doc_rows(spark, [(1, text, "en", "s")]), items(spark, *(bench or (ITEM,))), **kw).collect()
    return {r["item_id"]: r for r in rows}


def test_template():
    kinds, words = dc.template("Then Anna paid $3.50 for 5 km, 7kg and 1,000 m. The end")
    assert kinds == ["then", dc.NAME, "paid", dc.NUMBER, "for", dc.NUMBER, dc.UNIT, dc.QUANTITY, "and", dc.NUMBER, dc.UNIT, "the", "end"]
    assert words[1] == "anna"


def test_exact_and_reparameterised_items_are_found(llm):
    other = ITEM.replace("12", "44").replace("30", "9").replace("Anna", "Zoe").replace("Bert", "Max").replace("5 km", "8 miles")
    for text in (ITEM, other, "Some text before. " + other + " and some words after it", ITEM.replace(" ", "\n"), ITEM.upper().replace("KM", "km")[:0] + ITEM):
        hit = found(llm, text)[0]
        assert hit["coverage"] >= 0.8 and hit["slots"] >= 7


def test_inconsistent_slots_are_not(llm):
    mixed = ITEM.replace("gives Bert 12", "gives Carl 99").replace("so Anna", "so Dora")
    assert not found(llm, mixed)
    merged = ITEM.replace("Bert", "Anna").replace("30", "12").replace("5", "12")
    assert not found(llm, merged)  # different values of the item are one value here


def test_part_of_an_item_and_scattered_windows_are_not(llm):
    words = ITEM.split()
    assert not found(llm, " ".join(words[:12]))
    filler = " ".join(f"filler{i}" for i in range(60))
    assert not found(llm, f" {filler} ".join(" ".join(words[i:i + 7]) for i in range(0, len(words), 7)))


def test_short_items_and_ties(llm):
    assert set(found(llm, "we ask what is it now", "what is it", "what is it")) == {0, 1}
    assert not found(llm, "we ask what was it now", "what is it")


OPENERS = ("Tom has 12 apples and 30 pears in a basket. Lisa takes 4 apples away from the basket. "
           "Paul puts 7 pears back into it. Tom then eats 2 of the apples. How many apples does Lisa have now?")


def renamed(text, **names):
    for old, new in names.items():
        text = text.replace(old, new)
    return text


def test_names_that_open_sentences(llm):
    other = renamed(OPENERS, Tom="Zoe", Lisa="Max", Paul="Eve").replace("12", "51").replace("30", "8").replace("4", "9")
    assert found(llm, other, OPENERS)[0]["coverage"] == 1.0
    assert found(llm, "We read that " + other[0].upper() + other[1:], OPENERS) and found(llm, OPENERS, other)
    assert found(llm, OPENERS, OPENERS)[0]["coverage"] == 1.0
    assert found(llm, "Jim says: Hello Max. " + other, OPENERS)  # an opener of the item inside a sentence of the document, too
    mixed = renamed(OPENERS, Paul="Lisa").replace("Tom then", "Max then").replace("does Lisa", "does Tom").replace("30", "12")
    assert not found(llm, mixed, OPENERS)  # one name for two, two for one, one number for two
    assert not found(llm, renamed(OPENERS, Tom="The", Lisa="The", Paul="The"), OPENERS)


LONGER = ITEM + " with the other people"
FALSE = LONGER.replace("gives Bert 12", "gives Carl 99").replace("so Anna", "so Dora")
TRUE = LONGER.replace("12", "44").replace("30", "9").replace("Anna", "Zoe").replace("Bert", "Max")
EDITED = TRUE.replace("44 apples and walks", "44 apples or more and walks")  # no alignment alone has enough


def matched(text, item):
    return dc.Items([(0, item)], dc.WINDOW).matches(text, dc.COVERAGE, dc.AGREE)


@pytest.mark.parametrize("copy", [TRUE, EDITED])
@pytest.mark.parametrize("between", [" ", ". " + "filler " * 5, ". " + "filler " * 300])
@pytest.mark.parametrize("looks", [1, 3])
def test_a_look_alike_hides_no_copy(copy, between, looks):
    parts = [FALSE] * looks
    assert not matched(between.join(parts), LONGER)
    for text in (between.join([*parts, copy]), between.join([copy, *parts]), between.join([*parts, copy, *parts])):
        ((_, share, _, first, last),) = matched(text, LONGER)
        assert share >= 0.8 and "Zoe" in text.split()[first:last + 1]


def test_a_copy_among_sentences_alike():
    item = "Tom has 3 red apples. Lisa has 4 red apples. Tom has 5 red apples. Eve has 3 red apples."
    before, after = "Max has 8 red apples. " * 9, "Ada has 6 red apples. " * 9
    assert not matched(before + after, item)
    assert matched(before + item + " " + after, item)


def plain_matches(text, bench):
    """Items whose word windows (five, edge punctuation and case aside) are nearly all in the text."""
    def windows(t):
        k, _ = dc.template(t)
        n = min(5, len(k))
        return {tuple(k[i:i + n]) for i in range(len(k) - n + 1)} if k else set()
    own = windows(text)
    return {i for i, t in bench if windows(t) and len(windows(t) & own) >= 0.8 * len(windows(t))}


def test_op7_matches_brute_force(llm):
    bench = [(r["item_id"], r["text"]) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = llm.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(llm, SF).collect()}
    want = {(d["doc_id"], i) for d in docs for i in plain_matches(d["text"], bench)}
    assert got == want and got
    verbatim = {(d["doc_id"], i) for d in docs for i, t in bench if t in (d["text"] or "")}
    assert verbatim <= got


@pytest.mark.parametrize("slice_windows", [1_000_000, 60])
def test_slices_and_clean(llm, slice_windows):
    docs, bench = llm.read.parquet(f"{SF}/documents.parquet"), llm.read.parquet(f"{SF}/benchmark.parquet")
    pairs = {(r["doc_id"], r["item_id"]) for r in dc.find(docs, bench, slice_windows=slice_windows).collect()}
    assert pairs == {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(llm, SF).collect()}
    if slice_windows > 60:
        left = dc.clean(docs, bench, slice_windows=slice_windows)
        assert left.columns == docs.columns
        assert {r[0] for r in left.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - {p[0] for p in pairs}


def test_odd_rows(llm):
    bench = llm.createDataFrame([(0, None), (1, ""), (2, "twin text here"), (None, "a text without id"), (3, "... !!!")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in dc.find(doc_rows(llm, ODD), bench).collect())
    assert got == [("5", "2"), ("5", "2"), ("None", "None")]
    assert dc.clean(doc_rows(llm, ODD), bench).count() == len(ODD) - 3
    assert dc.find(doc_rows(llm, ODD), bench.limit(0)).count() == 0 and dc.clean(doc_rows(llm, ODD), bench.limit(0)).count() == len(ODD)
    assert dc.find(doc_rows(llm, ODD).limit(0), bench).count() == 0
