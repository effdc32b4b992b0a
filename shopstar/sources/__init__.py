"""Inputs: the delimited source layouts and reader, and the driver-table marts derivation."""
