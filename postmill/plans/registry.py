"""Where plan modules put their queries."""

QUERIES = {}
ORACLES = {}
OPERATORS = {}


def query(name, operators, sql=None):
    """Register a callable (spark, sf_dir) -> DataFrame under `name`, with the inventory ids it answers."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        OPERATORS[name] = tuple(operators.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put
