"""Embedding whitening by the exact characteristic polynomial.

1. Components become integers x. Each distinct vector counts once (the *fit list*), n of them with sums S. Tasks add up products
   of components exactly, so A = n * sum(x x^T) - S S^T, which is n^2 times the covariance, is an exact integer matrix.
2. The characteristic polynomial of A is found modulo many primes, one reduction to Hessenberg form a prime, dealt over tasks, and
   put together by Chinese remaindering. Its coefficients are exact.
3. All roots are real, so the sign changes of the shifted polynomial count the roots above a point exactly (Budan and Fourier).
   Bisection on integers encloses each wanted root, repeated ones included, as narrowly as asked.
4. Components are null vectors of A - root * I by inverse iteration in high-precision decimals; a repeated root gets as many
   orthogonal ones. Steps 3 and 4 run one task a component.
5. Every row is centred exactly (n * x - S is an integer), projected and scaled where it lies.

Only matrices of the vectors' width, never rows, reach the driver.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import share, ship_by_value, small_batches
from cohortry.llm.topk import is_finite
from cohortry.sources.scratch import keep

ship_by_value(__name__)

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
ROOT_BITS = 128  # a root is enclosed within its size / 2**ROOT_BITS, at least within 2**-64
EXACT_DOUBLE = 1 << 53
LARGEST_PRIME = 1 << 31  # products of two residues fit 64 bits
WIDE = "decimal(38,0)"


def quantised(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * x) + shift of each component as a long; beyond 64 bits the cast raises."""
    return F.transform(vector, lambda x: (F.floor(x.cast("double") * scale).cast("long") + F.lit(shift).cast("long")))


# --- exact sums ------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int, origin: int) -> np.ndarray:
    """Vectors less the origin as rows of 64-bit integers; a shorter vector stands for one with zeros (``origin``) at its end."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False) - origin
    return out


def products(y: np.ndarray) -> np.ndarray:
    """y^T y exactly, as Python integers: in doubles as long as no sum can leave their exact range."""
    size = max((abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))))
    if size * size * max(len(y), 1) < EXACT_DOUBLE:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _partial_sums(width: int, origin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(width, object), np.zeros((width, width), object)
        for b in small_batches(batches):
            y = _matrix(b.column(0), width, origin)
            n, total, square = n + len(y), total + y.sum(axis=0).astype(object), square + products(y)
        if n:
            i, j = np.triu_indices(width)
            entries = [n, *total, *square[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(entries)), pa.int32()), pa.array([Decimal(int(e)) for e in entries], pa.decimal128(38, 0))],
                names=["entry", "s"],
            )

    return run


def scatter(vectors: DataFrame, width: int, origin: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of the components and A = n^2 * covariance, exactly. ``vectors`` has one column of integer arrays.

    Each task sends width * (width + 3) / 2 + 1 numbers, which Spark adds up; a sum beyond 38 digits raises.
    """
    rows = vectors.mapInArrow(_partial_sums(width, origin), f"entry int, s {WIDE}").groupBy("entry").agg(F.sum("s").cast(WIDE).alias("s"))
    found = {r["entry"]: int(r["s"]) for r in rows.collect()}
    n = found.get(0, 0)
    y = [found.get(1 + i, 0) for i in range(width)]
    entry, a = 1 + width, [[0] * width for _ in range(width)]
    for i in range(width):
        for j in range(i, width):
            a[i][j] = a[j][i] = n * found.get(entry, 0) - y[i] * y[j]
            entry += 1
    return n, [s + n * origin for s in y], a


# --- characteristic polynomial ---------------------------------------------------------------------------------


def is_prime(p: int) -> bool:
    """Miller-Rabin with the bases that decide all numbers below 3.2e9."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds the bound."""
    out, product, p = [], 1, LARGEST_PRIME
    while product <= bound:
        p -= 1
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo p with zeros below the first subdiagonal."""
    h = a % p
    d = len(h)
    for k in range(d - 2):
        below = np.nonzero(h[k + 1 :, k])[0]
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    return h


def polynomial_of(h: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p, constant first, of the characteristic polynomial of a Hessenberg matrix, by leading blocks."""
    d = len(h)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        weights, chain = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * chain % p
            if i:
                chain = chain * int(h[i, i - 1]) % p
        shifted = np.concatenate([[0], polys[k, :-1]])
        polys[k + 1] = (shifted - (weights[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Exact integer coefficients, constant first, of det(t I - A) for a symmetric matrix without negative eigenvalues.

    Coefficients are bounded through the trace (Maclaurin); the residues of one prime after another are one row a prime, found in
    tasks.
    """
    d = len(a)
    trace = sum(a[i][i] for i in range(d))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_beyond(2 * bound)
    shared = share(spark, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(shared(), dtype=object).reshape(d, d)
        for b in batches:
            found = []
            for p in b.column(0).to_pylist():
                found.append(polynomial_of(hessenberg((exact % p).astype(np.int64), p), p).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, residues array<long>").collect()
    modulus = math.prod(primes)
    total = [0] * (d + 1)
    for r in rows:
        rest = modulus // r["p"]
        part = rest * pow(rest, -1, r["p"])
        for i, x in enumerate(r["residues"]):
            total[i] += x * part
    return [t % modulus if t % modulus <= modulus // 2 else t % modulus - modulus for t in total]


# --- roots -----------------------------------------------------------------------------------------------------


def roots_above(poly: list[int], point: int, bits: int) -> int:
    """How many roots of a real-rooted polynomial exceed point / 2**bits, each as often as it is repeated."""
    d = len(poly) - 1
    c = [x << (bits * (d - i)) for i, x in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(poly: list[int], point: int, bits: int) -> int:
    """The polynomial at point / 2**bits times a power of two."""
    out = 0
    for i, x in enumerate(reversed(poly)):
        out = out * point + (x << (bits * i))
    return out


def enclose_root(poly: list[int], k: int, top: int, bits: int) -> tuple[int, int, int]:
    """(low, high, count): the k-th largest root lies in (low, high] / 2**bits with ``high - low = 1``, and ``count`` roots are above
    ``high``. ``top`` is at least the largest root. As soon as one root is left between the limits, signs decide.
    """
    low, high, above_low, above_high = -1, top << bits, len(poly) - 1, 0
    while high - low > 1:
        middle = (low + high) // 2
        if above_low - above_high == 1:
            v = _value(poly, middle, bits)
            above = above_high if v == 0 or (v > 0) == (above_high % 2 == 0) else above_low
        else:
            above = roots_above(poly, middle, bits)
        if above >= k:
            low, above_low = middle, above
        else:
            high, above_high = middle, above
    return low, high, above_high


# --- components ------------------------------------------------------------------------------------------------


def _eliminate(m: list[list[Decimal]], tiny: Decimal) -> list[tuple[int, list[Decimal]]]:
    """Triangular factors in place, rows exchanged for the largest pivot; a vanishing pivot is replaced by a tiny one."""
    d, steps = len(m), []
    for k in range(d):
        p = max(range(k, d), key=lambda i: abs(m[i][k]))
        m[k], m[p] = m[p], m[k]
        if not m[k][k]:
            m[k][k] = tiny
        factors, tail = [], m[k][k + 1 :]
        for i in range(k + 1, d):
            f = m[i][k] / m[k][k]
            factors.append(f)
            if f:
                m[i][k + 1 :] = [x - f * y for x, y in zip(m[i][k + 1 :], tail)]
        steps.append((p, factors))
    return steps


def _solve(m: list[list[Decimal]], steps: list[tuple[int, list[Decimal]]], b: list[Decimal]) -> list[Decimal]:
    b, d = list(b), len(b)
    for k, (p, factors) in enumerate(steps):
        b[k], b[p] = b[p], b[k]
        for i, f in enumerate(factors, k + 1):
            b[i] -= f * b[k]
    for k in range(d - 1, -1, -1):
        b[k] = (b[k] - sum((x * y for x, y in zip(m[k][k + 1 :], b[k + 1 :])), Decimal(0))) / m[k][k]
    return b


def _unit(v: list[Decimal], against: list[list[Decimal]]) -> list[Decimal]:
    for w in against:
        s = sum((x * y for x, y in zip(v, w)), Decimal(0))
        v = [x - s * y for x, y in zip(v, w)]
    size = sum((x * x for x in v), Decimal(0)).sqrt()
    return [x / size for x in v]


def null_vectors(a: list[list[int]], root: Fraction, count: int, digits: int) -> list[list[float]]:
    """``count`` orthogonal unit vectors that A - root * I sends to zero, by inverse iteration, largest entry positive."""
    with decimal.localcontext() as context:
        context.prec = digits
        context.Emin, context.Emax = decimal.MIN_EMIN, decimal.MAX_EMAX
        mu = Decimal(root.numerator) / Decimal(root.denominator)
        d = len(a)
        m = [[Decimal(x) - (mu if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(a)]
        steps = _eliminate(m, Decimal(10) ** -digits)
        found: list[list[Decimal]] = []
        rng = np.random.default_rng(d)
        for _ in range(count):
            v = _unit([Decimal(int(x)) for x in rng.integers(1, 10**9, d)], found)
            for _ in range(4):
                v = _unit(_solve(m, steps, v), found)
            found.append(v)
        out = []
        for v in found:
            top = max(v, key=abs)
            out.append([float(x if top > 0 else -x) for x in v])
        return out


def eigenpairs(spark: SparkSession, a: list[list[int]], components: int = COMPONENTS) -> list[tuple[float, list[float]]]:
    """The largest positive eigenvalues of a symmetric integer matrix without negative ones, and unit eigenvectors.

    One task a root, then one task a distinct root; both find their numbers from the exact polynomial and the exact matrix alone.
    """
    d = len(a)
    trace = sum(a[i][i] for i in range(d))
    if not trace:
        return []
    poly = characteristic_polynomial(spark, a)
    positive = d - next(i for i, c in enumerate(poly) if c)
    wanted = min(components, positive)
    bits = max(64, ROOT_BITS - trace.bit_length() + 64)
    digits = 40 + math.ceil((trace.bit_length() + bits) * math.log10(2))
    shared_poly, shared_matrix = share(spark, poly), share(spark, a)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(0).to_pylist()
            enclosed = [enclose_root(shared_poly(), k, trace, bits) for k in ks]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([str(high) for _, high, _ in enclosed])], names=["k", "high"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, highs, counts = (c.to_pylist() for c in b.columns)
            found = [null_vectors(shared_matrix(), Fraction(2 * int(h) - 1, 2 << bits), n, digits) for h, n in zip(highs, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["k", "v"])

    first = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int").repartition(wanted, "k")
    highs = {r["k"]: int(r["high"]) for r in first.mapInArrow(roots, "k int, high string").collect()}
    groups: list[list[int]] = []
    for k in range(1, wanted + 1):  # roots that cannot be told apart, neighbouring enclosures included, are one
        if groups and highs[groups[-1][-1]] - highs[k] <= 1:
            groups[-1].append(k)
        else:
            groups.append([k])
    second = spark.createDataFrame([(g[0], str(highs[g[0]]), len(g)) for g in groups], "k int, high string, n int").repartition(len(groups), "k")
    by_first = {r["k"]: r["v"] for r in second.mapInArrow(vectors, "k int, v array<array<double>>").collect()}
    return [(float(Fraction(2 * highs[k] - 1, 2 << bits)), list(by_first[g[0]][i])) for g in groups for i, k in enumerate(g)]


# --- rows ------------------------------------------------------------------------------------------------------


def centred(x: np.ndarray, n: int, y_sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """n * x - S in doubles, and the exact sum of its squares per row. ``x`` and ``y_sums`` are both less the origin."""
    size = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max((abs(int(s)) for s in y_sums), default=0)
    if size * size * max(x.shape[1], 1) < 1 << 63:
        z = x * np.int64(n) - y_sums.astype(np.int64)
        return z.astype(np.float64), (z * z).sum(axis=1).tolist()
    z = x.astype(object) * n - y_sums
    return z.astype(np.float64), [int(s) for s in (z * z).sum(axis=1)]


def _projector(shared, width: int, origin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, roots, vectors = shared()
        y_sums = np.array([s - n * origin for s in sums], object)
        basis = (np.array(vectors) / np.sqrt(np.array(roots))[:, None]).T
        for b in small_batches(batches):
            z, squares = centred(_matrix(b.column(1), width, origin), n, y_sums)
            white = z @ basis
            offsets = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([Decimal(s) for s in squares], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(white).ravel())),
                ],
                names=["id", "deviation", "white"],
            )

    return run


def _white_products(means: list[float]):
    m = np.array(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(m), len(m)))
        for b in small_batches(batches):
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(m)) - m
            total += w.T @ w
        i, j = np.triu_indices(len(m))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    return run


def _identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity, measured on its rows in two passes."""
    means = [white.agg(*[F.avg(F.get("white", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()[i] for i in range(k)]
    sums = white.select("white").mapInArrow(_white_products(means), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return max(abs(r["s"] / n - (r["i"] == r["j"])) for r in sums.collect())


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``, one row per usable vector.

    ``whitened`` and ``explained`` are arrays over the components, by falling eigenvalue, at most ``components`` and at most the rank of
    the covariance (a direction without variance cannot be scaled to one). ``deviation`` is an exact decimal. Vectors
    that are null or hold a null, NaN or infinite component are left out. A shorter vector stands for one with zeros at its end, so
    an empty one is the zero vector. Repeated rows come back as often as they are there but count once in the fit, as do equal
    vectors of several ids; null ids are kept. Without two different vectors there is no component and the result is
    empty, as for an empty table. Other columns are not read. Quantised components must fit 64 bits and their sums of products 38
    digits; beyond that the run stops with an overflow error, never with a wrong number.
    """
    spark, vector = rows.sparkSession, F.col(f"`{vector_col}`")
    origin = shift  # exact sums are taken around it, which changes neither A nor n * x - S
    usable = keep(
        rows.filter(is_finite(vector)).select(F.col(f"`{id_col}`").alias("id"), quantised(vector, scale, shift).alias("x"))
    )
    width = usable.agg(F.max(F.size("x"))).first()[0] or 0
    zero = F.lit(shift).cast("long")
    whole = F.concat("x", F.array_repeat(zero, F.lit(width) - F.size("x")))
    fit = keep(usable.select(whole.alias("x")).distinct())
    n, sums, a = scatter(fit, width, origin) if width else (0, [], [])
    pairs = eigenpairs(spark, a, components) if n > 1 else []
    id_type = next(f.dataType for f in rows.schema.fields if f.name == id_col).simpleString()
    kind = f"id {id_type}, n long, deviation {WIDE}, whitened array<double>, explained array<double>, identity_error double"
    if not pairs:
        return spark.createDataFrame([], kind).withColumnRenamed("id", id_col)
    trace = sum(a[i][i] for i in range(width))
    project = _projector(share(spark, (n, sums, [e for e, _ in pairs], [v for _, v in pairs])), width, origin)
    made = f"deviation {WIDE}, white array<double>"
    on_fit = fit.select(F.lit(0).cast("long").alias("id"), "x").mapInArrow(project, f"id long, {made}")
    error = _identity_error(on_fit, n, len(pairs))
    return usable.mapInArrow(project, f"id {id_type}, {made}").select(
        F.col("id").alias(id_col),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("white").alias("whitened"),
        F.array(*[F.lit(e / trace) for e, _ in pairs]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whitened_components(rows: DataFrame) -> DataFrame:
    """One row per usable vector and component. The deviation is a long here: one beyond 64 bits raises."""
    made = whiten(rows)
    return made.select(
        "vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    ).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )
