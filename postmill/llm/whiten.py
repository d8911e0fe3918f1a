"""Whitening of embeddings by a covariance that is put together from variances only (polarisation).

Entries become integers x = floor(scale * c) + offset. Tasks sum the squares of every centred dimension i and of every sum
of two centred dimensions i and j; as (a + b)^2 = a^2 + b^2 + 2ab, half the difference of the three variances is the
covariance of i and j. All sums are exact: values are centred on the whole number m next to the mean before they are
squared, squares are added as integers, and the remainder r = S - n * m of a dimension is taken off afterwards, since
sum (n x - S)^2 = n (n sum (x - m)^2 - r^2), and alike for two dimensions. Only the finished fraction is rounded. The matrix
goes to eigh, and rows are projected on its components in tasks.

The driver holds one number per dimension pair, whatever the rows; each task sends one partial sum per dimension pair.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped and do not count; rows with a null
or repeated key stay, each by itself; no remaining row, or vectors without entries, give no rows; vectors of different
lengths and entries whose x is outside the range of a long are errors; a direction without variance has a null `whitened` and
is left out of identity_error, and without any variance `explained` is null; equal eigenvalues have some orthonormal basis;
other columns of the input are dropped unless they are in `keep`.
"""

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from postmill.llm.registry import Sent, query, table

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
#: Entries of vectors that a task handles together.
BLOCK_ENTRIES = 1 << 20
EXACT = DecimalType(38, 0)


@dataclass
class Fit:
    """What whitening needs: row count, sums, centres and remainders per dimension, matrix, eigenvalues, projection."""

    n: int
    sums: list
    centres: np.ndarray
    remainders: list
    covariance: np.ndarray
    values: np.ndarray
    projection: np.ndarray
    components: int

    @property
    def explained(self):
        trace = float(np.trace(self.covariance))
        return [float(v) / trace if trace > 0 else None for v in self.values[:self.components]]


def usable(df: DataFrame, vector="embedding") -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    def finite(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = F.forall(F.col(vector).cast("array<double>"), finite)
    return df.where(F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False)))


def integers(vectors: pa.Array, scale=SCALE, offset=OFFSET):
    """Rows of x = floor(scale * c) + offset from an Arrow column of lists of equal length, in blocks (first row, matrix)."""
    lengths = np.diff(vectors.offsets.to_numpy())
    width = int(lengths[0]) if len(lengths) else 0
    if (lengths != width).any():
        raise ValueError("vectors differ in length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), width)
    step = max(1, BLOCK_ENTRIES // max(1, width))
    for at in range(0, len(lengths), step):
        scaled = np.floor(flat[at:at + step] * scale)
        if scaled.size and np.abs(scaled).max() >= 2.0 ** 62:
            raise ValueError("an entry is outside the range of a long")
        yield at, scaled.astype(np.int64) + offset


def _exact(values, bound, rows):
    """The values as 64-bit integers if sums of `rows` squares below bound^2 fit, else as unbounded integers."""
    return values if bound * bound * max(1, rows) < 2 ** 63 else values.astype(object)


def _largest(x):
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _decimals(numbers):
    return pa.array([int(v) for v in numbers], pa.decimal128(38, 0))


def _sums(df, vector, scale, offset):
    """One row (width, dimension, n, total) per dimension."""
    schema = "width int, i int, n long, total decimal(38,0)"

    def part(batches):
        n, total = {}, {}
        for batch in batches:
            for _, x in integers(batch.column(0), scale, offset):
                width = x.shape[1]
                n[width] = n.get(width, 0) + len(x)
                fits = _largest(x) * len(x) < 2 ** 63
                total[width] = total.get(width, 0) + (x if fits else x.astype(object)).sum(axis=0).astype(object)
        for width, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n[width]] * width),
                 _decimals(sums)], ["width", "i", "n", "total"])

    parts = df.select(vector).mapInArrow(part, schema)
    return parts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("total").cast(EXACT).alias("total"))


def pair_sums(x, centres):
    """Exact sums over rows of (z_i + z_j)^2 for i < j and of z_i^2 for i = j, as {(i, j): int}, z being centred."""
    z = x - centres
    bound = 2 * _largest(z)
    z, width, out = _exact(z, bound, len(z)), x.shape[1], {}
    for i in range(width):
        pair = z[:, i:] + z[:, i:i + 1]
        pair[:, 0] = z[:, i]
        for j, total in enumerate((pair * pair).sum(axis=0), i):
            out[i, j] = int(total)
    return out


def _variances(df, vector, centres, scale, offset):
    """{(i, j): exact sum of squares} over all rows; one row per dimension pair reaches the driver."""
    def part(batches):
        total = {}
        for batch in batches:
            for _, x in integers(batch.column(0), scale, offset):
                for key, value in pair_sums(x, centres).items():
                    total[key] = total.get(key, 0) + value
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in total], pa.int32()), pa.array([j for _, j in total], pa.int32()),
                 _decimals(total.values())], ["i", "j", "total"])

    parts = df.select(vector).mapInArrow(part, "i int, j int, total decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("total").cast(EXACT).alias("total")).collect()
    return {(r["i"], r["j"]): int(r["total"]) for r in rows}


def covariance(squares, remainders, n):
    """The covariance matrix, divisor n, from the sums of squares of `pair_sums` by polarisation; rounded once per entry."""
    width = len(remainders)
    out = np.empty((width, width))

    def scatter(i, j):
        # n^2 times the sum of squares about the true mean, without remainder.
        r = remainders[i] if i == j else remainders[i] + remainders[j]
        return n * squares[i, j] - r * r

    single = [scatter(i, i) for i in range(width)]
    for i in range(width):
        out[i, i] = float(Fraction(single[i], n * n))
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = float(Fraction(scatter(i, j) - single[i] - single[j], 2 * n * n))
    return out


def projection_of(matrix, components):
    """Eigenvalues by falling size and the matrix that turns centred rows into whitened ones.

    A column is null (nan) where the direction has no variance beyond rounding. The sign makes the largest entry positive.
    """
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    floor = max(values[0], 0.0) * len(values) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(values > floor, vectors * signs / np.sqrt(np.maximum(values, 0)), np.nan)
    return np.where(values > floor, values, 0.0), scaled[:, :components]


def fit(df: DataFrame, vector="embedding", components=COMPONENTS, scale=SCALE, offset=OFFSET) -> Fit | None:
    """The whitening of all usable rows of df; None without rows or entries."""
    rows = usable(df, vector)
    sums = _sums(rows, vector, scale, offset).limit(1 << 24).collect()  # one row per dimension
    if not sums:
        return None
    width = sums[0]["width"]
    if any(r["width"] != width for r in sums):
        raise ValueError("vectors differ in length")
    n = sums[0]["n"]
    totals = [int(r["total"]) for r in sorted(sums, key=lambda r: r["i"])]
    centres = [(2 * s + n) // (2 * n) for s in totals]
    remainders = [s - n * m for s, m in zip(totals, centres)]
    centres = np.array(centres, dtype=np.int64)
    squares = _variances(rows, vector, centres, scale, offset)
    matrix = covariance(squares, remainders, n)
    values, projection = projection_of(matrix, components)
    return Fit(n, totals, centres, remainders, matrix, values, projection, min(components, width))


def _whitened(x, model):
    z = x - model.centres
    means = np.array([r / model.n for r in model.remainders])
    return z, (z - means) @ model.projection


def _deviations(z, model):
    """Exact sums over dimensions of (n * x - S)^2 per row."""
    bound = model.n * (_largest(z) + 1)
    remainders = np.array(model.remainders, dtype=object)
    if bound * bound * max(1, z.shape[1]) < 2 ** 63:
        y = model.n * z - remainders.astype(np.int64)
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    y = model.n * z.astype(object) - remainders
    return _decimals((y * y).sum(axis=1))


def identity_error(df: DataFrame, model: Fit, vector="embedding", scale=SCALE, offset=OFFSET):
    """Largest absolute entry of the covariance of all whitened rows minus the identity, over directions with variance."""
    sent, width = Sent(df.sparkSession, model), model.components

    def part(batches):
        model, total, products = sent.get(), np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for _, x in integers(batch.column(0), scale, offset):
                w = _whitened(x, model)[1]
                total += w.sum(axis=0)
                products += w.T @ w
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(products.ravel()), pa.array(total[i])],
            ["i", "j", "product", "total"])

    parts = usable(df, vector).select(vector).mapInArrow(part, "i int, j int, product double, total double")
    rows = parts.groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("total").alias("total")).collect()
    products, means = np.zeros((width, width)), np.zeros(width)
    for r in rows:
        products[r["i"], r["j"]] = r["product"] / model.n
        means[r["i"]] = r["total"] / model.n
    gaps = np.abs(products - np.outer(means, means) - np.eye(width))
    return float(np.nanmax(gaps)) if not np.isnan(gaps).all() else None


def whiten(df: DataFrame, keep=("vec_id",), vector="embedding", components=COMPONENTS, scale=SCALE, offset=OFFSET) -> DataFrame:
    """Per usable row and component: the columns `keep`, component (from 1), n, deviation (decimal), whitened, explained,
    identity_error. Kept columns named like a result are replaced by it."""
    keep = [c for c in keep if c not in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    fields = [StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", EXACT),
              StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
              StructField("identity_error", DoubleType())]
    schema = StructType([df.schema[c] for c in keep] + fields)
    model = fit(df, vector, components, scale, offset)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, sent = identity_error(df, model, vector, scale, offset), Sent(df.sparkSession, model)

    def part(batches):
        model = sent.get()
        width, explained = model.components, model.explained
        for batch in batches:
            for at, x in integers(batch.column("_vector"), scale, offset):
                z, w = _whitened(x, model)
                rows = np.repeat(np.arange(len(x)), width)
                values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(rows + at)) for c in keep] + [
                        pa.array(np.tile(np.arange(1, width + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), model.n)),
                        _deviations(z, model).take(pa.array(rows)), values, pa.array(explained * len(x), pa.float64()),
                        pa.array([error] * len(rows), pa.float64())], schema.names)

    return usable(df, vector).select(*keep, F.col(vector).alias("_vector")).mapInArrow(part, schema)


@query("op13_whitening")
def op13(spark, sf_dir):
    """Whitens all embeddings by their first 32 components."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
