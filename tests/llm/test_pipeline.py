import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopstar.llm import decontaminate, langid, mixing, quality, queries, simhash
from shopstar.llm.common import in_fold
from tests.llm.conftest import ODD, SF, doc_rows

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(llm, tmp_path_factory):
    """What every stage returns, written and read again."""
    docs, out = llm.read.parquet(f"{MID}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(llm, docs, MID).write.parquet(path)
        out.append((docs, docs := llm.read.parquet(path)))
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_apply_their_operators(llm, stages):
    before, after = stages[0]
    model = quality.fit(before, llm.read.parquet(f"{MID}/labels.parquet"), ~in_fold("__id", 4, 2))
    assert ids(after) == ids(quality.score(before, model, out="q").where("q >= 0.7"))
    before, after = stages[1]
    assert ids(after) == ids(langid.predict(before, langid.fit(before, ~in_fold("__id", 4, 2)), out="l").where("not l.rejected"))
    before, after = stages[2]
    assert ids(after) == {r[0] for r in simhash.components(before).select("component_id").distinct().collect()}
    before, after = stages[3]
    assert ids(after) == ids(before) - ids(decontaminate.find(before, llm.read.parquet(f"{MID}/benchmark.parquet")))
    before, after = stages[4]
    mix = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["taken"]}
    assert {r["doc_id"]: r["copies"] for r in after.collect()} == mix


def test_columns_and_texts_stay(llm, stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    source = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{MID}/documents.parquet").collect()}
    assert all(source[r["doc_id"]] == r["text"] for r in stages[-1][1].collect())


def test_filters_keep_clean_documents(llm, stages):
    """Labelled good documents pass quality and language; bad ones go."""
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{MID}/labels.parquet").collect()}
    kept = ids(stages[1][1])
    good, bad = {i for i, q in labels.items() if q == 1}, {i for i, q in labels.items() if q == 0}
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.02 * len(bad)


def test_run_equals_its_stages(llm, stages):
    got = corpus_pipeline.run(llm, MID)
    assert got.columns == stages[-1][1].columns
    assert got.exceptAll(stages[-1][1]).count() == 0 and got.count() == stages[-1][1].count()


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_and_empty_tables_pass_every_stage(llm, rows):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = doc_rows(llm, rows)
        assert stage(llm, docs, SF).columns == docs.columns
        assert stage(llm, docs, SF).count() <= len(rows)
    assert corpus_pipeline.STAGES[-1][1](llm, doc_rows(llm, rows), SF).count() <= len(rows)


HELPERS = ["__quality", "__langid", "__row", "__found", "__key", "__hash", "__passes", "__threshold", "__size", "__fp", "__rest", "__id", "copies", "size"]


def test_columns_named_like_helpers_pass_every_stage(llm, tmp_path):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS})
    given = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(llm, docs, SF).write.parquet(str(tmp_path / name))
        docs = llm.read.parquet(str(tmp_path / name))
    assert docs.columns == [*given, "copies_"]
    rows = docs.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in HELPERS)


def rows_of(cursor):
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(map(repr, ([r[i] for i in order] for r in cursor.fetchall())))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(llm, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](llm, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, ([r[c] for c in cols] for r in df.collect())))
    assert got == rows_of(con.execute(queries.oracle_sql()[name]))
