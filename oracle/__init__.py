"""SQL twins of the registered queries, for a single-node checker.

Every twin is plain SQL over the given tables. Shared parts are named CTEs in
`oracle.parts`; a twin is completed with just the CTEs it mentions.
"""
from oracle.parts import complete


def all_sql() -> dict:
    from oracle import history, ingest, live, network, rain, scalar, state, tables
    twins = {}
    for module in (ingest, history, rain, network, scalar, live, state, tables):
        for name, sql in module.SQL.items():
            twins[name] = complete(sql)
    return twins
