"""The registered queries of the reference's operators: name, Spark plan, DuckDB twin."""

from tessera.plans import artifacts, content, directory, evidence, flow, ledger, mutations, product, research, revenue, scalars, streams, workflow

QUERIES: dict = {}
ORACLES: dict = {}

for module in (product, directory, revenue, scalars, content, evidence, research, flow, ledger, mutations, workflow, streams, artifacts):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
