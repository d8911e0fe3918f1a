"""Where the operator modules of this subpackage put their queries and SQL twins."""

from pyspark import cloudpickle

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a callable (spark, sf_dir) -> DataFrame under `name`."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


class Sent:
    """An object sent to all tasks once, together with the code of its class, so that workers need not have this package."""

    def __init__(self, spark, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        """The object; ask once per task."""
        return cloudpickle.loads(self.data.value)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
