"""Embedding whitening (12): components from the exact characteristic polynomial of the integer scatter.

1. Vectors become integers x; each distinct one counts once (the fit list: n vectors, sums S). Tasks add up integer
   products exactly, Spark adds the tasks' sums as decimals. The driver holds d * (d + 3) / 2 numbers, d the length of a
   vector, and from them the scatter M = n * sum(x x') - S S', which is n^2 times the covariance V, in whole numbers.
2. Characteristic polynomial of M: tasks reduce M modulo a prime each to Hessenberg form, whose polynomial is a
   recurrence; Chinese remaindering puts the whole coefficients together. All roots are in [0, trace], so the coefficients
   are below (1 + trace / d)^d, which says how many primes are needed.
3. Its repeated factors come from greatest common divisors modulo the same primes, so every multiplicity is exact. All
   roots are real: the sign changes of p(x + a) count the roots above a exactly. The largest ones are isolated by
   bisection with that count and narrowed by the signs of the square-free part, in whole numbers.
4. Null-space inverse iteration: M - e I is factorised in decimals, with digits chosen by the root's distance from the
   next one, and a few solves from fixed starts span the null space; the vectors of a repeated root are made orthogonal.
5. Whitened values, their covariance over the fit list and the exact deviations are computed in the tasks from the
   components (a few times d numbers).

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are vectors whose
length isn't the commonest one (ties: the longer); entries beyond a long saturate. Repeated rows come back once each and
count once in the fit. Components of no variance have whitened null and explained 0, and take no part in identity_error
(0 when none has variance). No rows give no rows. Extra columns aren't read. A null vec_id is kept as it is.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm.common import read_table, stage, unstage

SCALE = 256
COMPONENTS = 4
#: Primes below this bound: products of two residues fit a signed 64-bit number.
PRIME_BOUND = 1 << 31
#: Binary digits by which a root is narrowed at a time, and how far off, in the width of its interval, the next root is.
ROOT_BITS = 160
APART = 1 << 60
EXACT = 1 << 53  # whole numbers up to this are exact as doubles
LIMB = 1 << 60  # sums leave a task as digits to this base


# ------------------------------------------------------------------ scatter

def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    c = F.col("c")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    sound = F.coalesce(c.isNotNull() & (F.size(c) > 0)
                       & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))), F.lit(False))
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long"))
    return rows.where(sound).select("vec_id", x.alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of x and x x' over the rows: in doubles where every sum is exact, else in Python's whole numbers."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if top * top * len(x) < EXACT:
        f = x.astype(np.float64)
        return x.sum(axis=0).astype(object), (f.T @ f).astype(np.int64).astype(object)
    o = x.astype(object)
    return o.sum(axis=0), o.T @ o


def fit_sums(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and sum(x x') of the fit list."""
    upper = [(i, j) for i in range(dim) for j in range(i, dim)]
    at = np.triu_indices(dim)

    def partial(batches: Iterator[pa.RecordBatch]):
        n, s, q = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(lo, 4096), dim)
                one, two = products(x)
                n, s, q = n + len(x), s + one, q + two
        if n:
            rows = []
            for k, v in enumerate([n, *s, *q[at]]):
                place = 0
                while abs(v) >= LIMB:  # the last limb has the sign
                    rows.append((k, place, v % LIMB))
                    v, place = v // LIMB, place + 1
                rows.append((k, place, v))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=pa.schema(
                [("k", pa.int64()), ("place", pa.int64()), ("v", pa.int64())]))
    sums: dict[int, int] = {}
    for r in (fit.select("x").mapInArrow(partial, "k long, place long, v long").groupBy("k", "place")
              .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()):  # 1 + d + d (d + 1) / 2 times the limbs
        sums[r.k] = sums.get(r.k, 0) + int(r.v) * LIMB ** r.place
    square = [[0] * dim for _ in range(dim)]
    for k, (i, j) in enumerate(upper):
        square[i][j] = square[j][i] = sums.get(1 + dim + k, 0)
    return sums.get(0, 0), [sums.get(1 + i, 0) for i in range(dim)], square


# ------------------------------------------------------------------ polynomial

def primes(how_many: int, below: int = PRIME_BOUND) -> list[int]:
    """The largest primes below a bound, falling (Miller-Rabin with bases that are exact for these sizes)."""
    def prime(n: int) -> bool:
        d, twos = n - 1, 0
        while d % 2 == 0:
            d, twos = d // 2, twos + 1
        for base in (2, 3, 5, 7):
            v = pow(base, d, n)
            if v in (1, n - 1):
                continue
            for _ in range(twos - 1):
                v = v * v % n
                if v == n - 1:
                    break
            else:
                return False
        return True
    out, n = [], below - 1
    while len(out) < how_many:
        if prime(n):
            out.append(n)
        n -= 2
    return out


def dot(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b modulo p for residues."""
    return (a * b % p).sum(axis=-1) % p


def charpoly_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of det(x I - m) modulo p: reduction to Hessenberg form, then its recurrence."""
    h, d = m.astype(np.int64) % p, len(m)
    for k in range(d - 2):
        rows = np.flatnonzero(h[k + 1:, k])
        if not len(rows):
            continue
        pivot = k + 1 + int(rows[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        f = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + dot(h[:, k + 2:], f, p)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - int(h[k, k]) * polys[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            polys[k + 1] = (polys[k + 1] - int(h[i, k]) * below % p * polys[i]) % p
    return polys[d].tolist()


def remainder_lift(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """Whole numbers (of least absolute value) with the given residues."""
    value, product = list(residues[0]), moduli[0]
    for row, p in zip(residues[1:], moduli[1:]):
        inverse = pow(product % p, -1, p)
        value = [v + product * ((r - v) * inverse % p) for v, r in zip(value, row)]
        product *= p
    return [v - product if 2 * v > product else v for v in value]


def primes_for(trace: int, dim: int) -> list[int]:
    """Primes whose product exceeds twice every coefficient of a polynomial with roots >= 0 that add up to ``trace``."""
    bits = dim * math.log2(1 + trace / dim) + 2 if trace else 2
    return primes(math.ceil(bits / 30.9) + 1)


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients (constant first) of the characteristic polynomial of a positive semidefinite whole matrix; one
    prime a row, so tasks share them."""
    dim = len(m)
    moduli = primes_for(sum(m[i][i] for i in range(dim)), dim)
    sent = spark.sparkContext.broadcast(m)

    def reduce_(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                residues = np.array([[v % p for v in row] for row in sent.value], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([charpoly_mod(residues, p)], pa.list_(pa.int64()))], ["p", "c"])
    tasks = max(1, min(len(moduli) // 8, 2 * spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks)
    rows = {r.p: r.c for r in table.mapInArrow(reduce_, "p long, c array<long>").collect()}  # primes x (d + 1) numbers
    sent.destroy()
    return remainder_lift([rows[p] for p in moduli], moduli)


def derivative(p: list[int]) -> list[int]:
    return [k * c for k, c in enumerate(p)][1:]


def divide_mod(a: list[int], b: list[int], p: int) -> tuple[list[int], list[int]]:
    """Quotient and remainder modulo p; both constant first, ``b`` monic."""
    a, out = [c % p for c in a], [0] * max(0, len(a) - len(b) + 1)
    for k in range(len(out) - 1, -1, -1):
        f = out[k] = a[k + len(b) - 1]
        if f:
            for i, c in enumerate(b):
                a[k + i] = (a[k + i] - f * c) % p
    rest = a[:len(b) - 1]
    while rest and not rest[-1]:
        rest.pop()
    return out, rest


def gcd_mod(a: list[int], b: list[int], p: int) -> list[int]:
    """The monic greatest common divisor modulo p."""
    a, b = [c % p for c in a], [c % p for c in b]
    for v in (a, b):
        while v and not v[-1]:
            v.pop()
    while b:
        lead = pow(b[-1], -1, p)
        b = [c * lead % p for c in b]
        a, b = b, divide_mod(a, b, p)[1]
    lead = pow(a[-1], -1, p)
    return [c * lead % p for c in a]


def common(a: list[int], b: list[int], moduli: list[int]) -> list[int]:
    """The monic greatest common divisor of two whole polynomials, ``a`` monic with roots >= 0: lifted from the primes
    with the least degree (others divide by chance)."""
    first = gcd_mod(a, b, moduli[0])
    if len(first) == 1:
        return [1]
    found = {p: gcd_mod(a, b, p) for p in moduli}
    least = min(len(g) for g in found.values())
    good = [p for p in moduli if len(found[p]) == least]
    return remainder_lift([found[p] for p in good], good)


def quotient(a: list[int], b: list[int]) -> list[int]:
    """a / b for a monic divisor, exact."""
    a, out = list(a), [0] * (len(a) - len(b) + 1)
    for k in range(len(out) - 1, -1, -1):
        f = out[k] = a[k + len(b) - 1]
        for i, c in enumerate(b):
            a[k + i] -= f * c
    if any(a[:len(b) - 1]):
        raise ArithmeticError("the divisor leaves a remainder")
    return out


# ------------------------------------------------------------------ roots

def scaled(p: list[int], bits: int) -> list[int]:
    """Coefficients of 2^(bits * degree) * p(x / 2^bits): the roots times 2^bits."""
    n = len(p) - 1
    return [c << (bits * (n - k)) for k, c in enumerate(p)]


def roots_above(p: list[int], a: int) -> int:
    """The number of roots above ``a`` of a polynomial with real roots only: the sign changes of p(x + a)."""
    c = list(p)
    n = len(c)
    for i in range(n - 1):
        for k in range(n - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def value(p: list[int], a: int) -> int:
    out = 0
    for c in reversed(p):
        out = out * a + c
    return out


@dataclass
class Root:
    """A root in (``low``, ``low + 1``] / 2^``bits`` and how often it occurs."""

    low: int
    bits: int
    times: int

    def decimal(self, context: Context) -> Decimal:
        return context.divide(Decimal(2 * self.low + 1), Decimal(1 << (self.bits + 1)))


def narrowed(p: list[int], lo: int, hi: int) -> int:
    """The number below the only root in (lo, hi]: that root is in (number, number + 1]."""
    top = value(p, hi)
    if top == 0:
        return hi - 1
    while hi - lo > 1:
        middle = (lo + hi) // 2
        v = value(p, middle)
        if v == 0:
            return middle - 1
        if (v > 0) == (top > 0):
            hi = middle
        else:
            lo = middle
    return lo


def largest_roots(p: list[int], count: int, trace: int, moduli: list[int]) -> list[Root]:
    """The largest positive roots of a monic polynomial with roots >= 0, with multiplicity, until ``count`` are met."""
    chain = [p]  # of repeated factors: a root of multiplicity m is in the first m
    while len(chain[-1]) > 1:
        chain.append(common(chain[-1], derivative(chain[-1]), moduli))
    simple = [quotient(a, b) for a, b in zip(chain, chain[1:])]  # [k]: each root of multiplicity over k, once
    free = simple[0]
    distinct = len(free) - 1 - (free[0] == 0)  # above 0
    out, found = [], 0
    for above in range(distinct):  # the number of larger roots
        if found >= count:
            break
        q, bits, lo, hi = free, 0, 0, trace
        while lo == 0 or roots_above(q, lo) > above + 1 or roots_above(q, hi) < above:
            if hi - lo == 1:
                bits, lo, hi = bits + 32, lo << 32, hi << 32
                q = scaled(free, bits)
            middle = (lo + hi) // 2
            if roots_above(q, middle) > above:
                lo = middle
            else:
                hi = middle
        while True:  # until the next root is far away, counted in the width of this one's interval
            bits, lo, hi = bits + ROOT_BITS, lo << ROOT_BITS, hi << ROOT_BITS
            q = scaled(free, bits)
            lo = narrowed(q, lo, hi)
            hi = lo + 1
            if roots_above(q, lo - APART) - roots_above(q, hi + APART) == 1:
                break
        times = 1
        for f in simple[1:]:
            f = scaled(f, bits)
            if roots_above(f, lo) == roots_above(f, hi):
                break
            times += 1
        out.append(Root(lo, bits, times))
        found += times
    return out


# ------------------------------------------------------------------ components

def null_space(m: list[list[int]], root: Root, wanted: int) -> list[list[Decimal]]:
    """Orthonormal vectors of the null space of m - root I by inverse iteration in decimals."""
    dim = len(m)
    trace = sum(m[i][i] for i in range(dim))
    digits = 40 + math.ceil((trace.bit_length() + root.bits) * 0.302)  # the root's interval against the whole matrix
    with localcontext(Context(prec=digits, Emax=10 ** 9, Emin=-10 ** 9)) as context:
        e = root.decimal(context)
        a = [[Decimal(v) - e if i == j else Decimal(v) for j, v in enumerate(row)] for i, row in enumerate(m)]
        order = list(range(dim))
        tiny = (abs(e) + 1).scaleb(-context.prec)
        for k in range(dim):  # m - e I = L U with row exchanges, in place
            best = max(range(k, dim), key=lambda i: abs(a[i][k]))
            a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            top, pivot = a[k], a[k][k]
            for i in range(k + 1, dim):
                row = a[i]
                if row[k]:
                    f = row[k] = row[k] / pivot
                    for j in range(k + 1, dim):
                        row[j] -= f * top[j]

        def solve(b):
            y = [b[i] for i in order]
            for i in range(dim):
                row = a[i]
                y[i] -= sum((row[j] * y[j] for j in range(i)), Decimal(0))
            for i in range(dim - 1, -1, -1):
                row = a[i]
                y[i] = (y[i] - sum((row[j] * y[j] for j in range(i + 1, dim)), Decimal(0))) / row[i]
            return y

        def unit(y):
            size = sum((v * v for v in y), Decimal(0)).sqrt()
            return [v / size for v in y]

        def apart(y):
            for u in basis:
                share = sum((v * w for v, w in zip(u, y)), Decimal(0))
                y = [v - share * w for v, w in zip(y, u)]
            return y
        basis: list[list[Decimal]] = []
        for start in range(wanted):
            # Fixed random starts; each solve takes off what the null space doesn't hold.
            draw = random.Random(start)
            y = unit([Decimal(draw.randrange(1, 1 << 40)) for _ in range(dim)])
            for _ in range(3):
                y = unit(apart(solve(unit(apart(y)))))
            largest = max(range(dim), key=lambda i: (abs(y[i]), -i))
            basis.append([-v for v in y] if y[largest] < 0 else y)
        return basis


@dataclass
class Whitening:
    """A fitted whitening: n vectors with sums S; unit components, falling eigenvalues of V and their shares of trace(V)."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]


def fit_components(spark: SparkSession, n: int, sums: list[int], square: list[list[int]],
                   count: int = COMPONENTS) -> Whitening:
    dim = len(sums)
    m = [[n * square[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(m[i][i] for i in range(dim))
    count = min(count, dim)
    vectors, values, shares = [], [], []
    if trace:
        poly = characteristic(spark, m)
        for root in largest_roots(poly, count, trace, primes_for(trace, dim)):
            for v in null_space(m, root, min(root.times, count - len(vectors))):
                with localcontext(Context(prec=60, Emax=10 ** 9, Emin=-10 ** 9)) as context:
                    e = root.decimal(context)
                    vectors.append([float(c) for c in v])
                    values.append(float(e / (Decimal(n) * n)))
                    shares.append(float(e / trace))
    missing = count - len(vectors)
    components = np.array(vectors + [[0.0] * dim] * missing, np.float64).reshape(count, dim)
    return Whitening(n, sums, components, values + [0.0] * missing, shares + [0.0] * missing)


# ------------------------------------------------------------------ application

def whitened(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """Rows of whitened values, NaN for components of no variance. n x - S is exact before it is projected."""
    root = np.sqrt(np.array(fit.eigenvalues)) * fit.n
    c = centred(x, fit).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(root > 0, (c @ fit.components.T) / root, np.nan)


def centred(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """n x - S in whole numbers: longs where they fit, else Python's."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    limit = fit.n * top + max((abs(s) for s in fit.sums), default=0)
    if limit * limit * len(fit.sums) < 1 << 63:
        return fit.n * x - np.array(fit.sums, np.int64)
    return fit.n * x.astype(object) - np.array(fit.sums, object)


def identity_error(fit_list: DataFrame, fit: Whitening) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|."""
    live = [k for k, e in enumerate(fit.eigenvalues) if e > 0]
    if not live:
        return 0.0
    dim, at = len(fit.sums), np.triu_indices(len(live))

    def partial(batches: Iterator[pa.RecordBatch]):
        s, q = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                w = whitened(matrix(batch.column(0).slice(lo, 4096), dim), fit)[:, live]
                s += w.sum(axis=0)
                q += w.T @ w
        v = np.concatenate((s, q[at]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(v)), pa.int32()), pa.array(v)], ["k", "v"])
    sums = {r.k: r.v for r in fit_list.select("x").mapInArrow(partial, "k int, v double").groupBy("k")
            .agg(F.sum("v").alias("v")).collect()}  # a few numbers a component
    mean = np.array([sums[k] for k in range(len(live))]) / fit.n  # of values centred before they were multiplied
    out = 0.0
    for k, (i, j) in enumerate(zip(*at)):
        out = max(out, abs(sums[len(live) + k] / fit.n - mean[i] * mean[j] - (i == j)))
    return float(out)


def whiten(embeddings: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error), a row for each vector that
    takes part and each component."""
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, " \
             "identity_error double"
    sizes = vectors.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["dim"]
    vectors = vectors.where(F.size("x") == dim)
    fit_list = stage(vectors.select("x").distinct(), "fit")
    fit = fit_components(spark, *fit_sums(fit_list, dim), count)
    error = identity_error(fit_list, fit)
    unstage(fit_list)
    kept = len(fit.eigenvalues)
    sent = spark.sparkContext.broadcast(fit)

    def apply(batches: Iterator[pa.RecordBatch]):
        from decimal import Decimal as D
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, own = matrix(part.column(1), dim), sent.value
                c = centred(x, own)
                far = [D(int(v)) if abs(int(v)) < 10 ** 38 else None for v in (c * c).sum(axis=1)]
                w = whitened(x, own)
                rows = np.repeat(np.arange(len(x)), kept)
                flat = w.ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(rows), own.n, np.int64)),
                     pa.array(far, pa.decimal128(38, 0)).take(pa.array(rows)),
                     pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(np.tile(own.explained, len(x))),
                     pa.array(np.full(len(rows), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.mapInArrow(apply, schema)


def op12(spark, sf_dir: str) -> DataFrame:
    out = whiten(read_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
