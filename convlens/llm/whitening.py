"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, ``floor(64 c)`` plus a constant; a constant moves
neither a covariance nor a deviation, so the sums are taken without it.

1. *Scatter*: of the different integer vectors (the fit list, n of them) one
   aggregation gives the sums ``S`` and products ``G``, exact at any size
   (32-bit limbs); ``M = n G - S S'`` is n**2 times the covariance and whole.
2. *Polynomial*: modulo each of enough 31-bit primes M is brought to Hessenberg
   form and its characteristic polynomial read off, tasks taking primes; Chinese
   remaindering gives the whole coefficients.
3. *Roots*: all roots are real and none is negative, so the sign changes of the
   coefficients after a shift count the roots beyond a number exactly (a zero
   root shows as zero coefficients). Bisection isolates the largest roots and
   narrows them to ``2**-PRECISION`` of their size; roots closer together than
   ``2**-CLUSTER`` count as one of that multiplicity.
4. *Components*: null vectors of ``M - root`` by inverse iteration in
   fixed-point integers of ``BITS`` bits, a block of vectors for a multiple
   root; one task a root. The largest entry of a component is positive.
5. A map projects every row; another, over the fit list, measures how far the
   covariance of the result is from the identity.

The driver holds numbers by dimension squared, never rows.

Defined results: vectors that are null, empty, or hold null or non-finite
entries (or such that 64 times them is no finite double) take no part; vectors
of different lengths are fitted and whitened apart; rows repeating an id or a
vector all stay, also with a null id; components whose root is zero have no
whitened value and are left out, so a table of one different vector, like an
empty one, gives no row; a deviation beyond 64 bits is null in ``deviation``
and whole in ``deviation_digits``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlens.llm.arrow import prepare
from convlens.session import cut_lineage, scratch

SCALE = 64
COMPONENTS = 16
PRECISION = 160  # bits to which a root is known
CLUSTER = 100  # bits from which on roots are told apart
BITS = 384  # fraction bits of the inverse iteration
ROUNDS = 3
LIMB = 32


def integers(vec: Column, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of every entry, as a double that holds an integer; null where the vector takes no part."""
    whole = F.transform(vec, lambda e: e.cast("double") * F.lit(float(scale)))
    fine = F.forall(whole, lambda z: z.isNotNull() & ~F.isnan(z) & (F.abs(z) < F.lit(float("inf"))))
    floor = F.transform(whole, lambda z: F.when(F.abs(z) < float(1 << 53), F.floor(z).cast("double")).otherwise(z))
    return F.when(vec.isNotNull() & (F.size(vec) > 0) & fine, floor)


def _matrices(column):
    """The vectors of an Arrow list column by length: ``(rows, matrix)``."""
    lens = column.value_lengths().to_numpy()
    flat, at = column.flatten().to_numpy(), np.cumsum(lens) - lens
    for d in np.unique(lens):
        rows = np.flatnonzero(lens == d)
        yield int(d), rows, flat[at[rows][:, None] + np.arange(d)]


def _exact(y: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def products(y: np.ndarray) -> np.ndarray:
    """``[1 y]' [1 y]`` of integer-valued rows, as Python integers."""
    z = np.concatenate([np.ones((len(y), 1)), y], axis=1)
    most = np.abs(z).max(axis=1)
    total = np.zeros((z.shape[1], z.shape[1]), object)
    small = z[most < 1 << 26]
    if len(small):
        # products of so many rows stay below 2**53, where doubles hold every integer
        step = max(1, int((1 << 53) // int(np.abs(small).max()) ** 2))
        for a in range(0, len(small), step):
            part = small[a : a + step]
            total = total + (part.T @ part).astype(np.int64).astype(object)
    for row in _exact(z[most >= 1 << 26]):
        total = total + np.outer(row, row)
    return total


def scatter(fit: DataFrame) -> dict[int, np.ndarray]:
    """By length d the matrix ``[1 y]' [1 y]`` of the rows of ``fit`` (``y array<double>``)."""
    import pyarrow as pa

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, y in _matrices(batch.column(0)):
                own[d] = own[d] + products(y) if d in own else products(y)
        for d, total in own.items():
            out: list[tuple[int, int, int, int]] = []
            for i in range(d + 1):
                for j in range(i, d + 1):
                    value, limb = int(total[i, j]), 0
                    sign, value = (-1, -value) if value < 0 else (1, value)
                    while value:
                        out.append((i, j, limb, sign * (value & ((1 << LIMB) - 1))))
                        value, limb = value >> LIMB, limb + 1
            cols = [pa.array(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(out), pa.int64()), *cols], names=["d", "i", "j", "limb", "v"])

    limbs = fit.select("y").mapInArrow(run, "d long, i long, j long, limb long, v long")
    found = limbs.groupBy("d", "i", "j", "limb").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        m = out.setdefault(r["d"], np.zeros((r["d"] + 1, r["d"] + 1), object))
        m[r["i"], r["j"]] += r["v"] << (LIMB * r["limb"])
    return {d: np.triu(m) + np.triu(m, 1).T for d, m in out.items()}


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    s = ((n - 1) & -(n - 1)).bit_length() - 1
    for a in (2, 3, 5, 7):  # enough below 3.2e9
        x = pow(a, (n - 1) >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product has more than ``bits`` bits."""
    out, have, n = [], 1, (1 << 31) + 1
    while have.bit_length() <= bits:
        n -= 2
        if _is_prime(n):
            out.append(n)
            have *= n
    return out


def _inverses(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.array([pow(int(a), -1, int(q)) if a else 0 for a, q in zip(x, p, strict=True)], np.int64)


def polynomials(m: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Characteristic polynomial of ``m`` modulo each prime, coefficients from ``x**0`` up, one row a prime."""
    p = np.array(moduli, np.int64)
    h = np.array([[[int(v) % q for v in row] for row in m] for q in moduli], np.int64)
    every, d = np.arange(len(p)), len(m)
    q2, q3 = p[:, None], p[:, None, None]
    for k in range(d - 2):
        pivot = k + 1 + (h[:, k + 1 :, k] != 0).argmax(1)
        h[every, pivot], h[:, k + 1] = h[:, k + 1].copy(), h[every, pivot].copy()
        h[every, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), h[every, :, pivot].copy()
        u = h[:, k + 2 :, k] * _inverses(h[:, k + 1, k], p)[:, None] % q2
        h[:, k + 2 :] = (h[:, k + 2 :] - u[:, :, None] * h[:, k + 1, None, :] % q3) % q3
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * u[:, None, :] % q3).sum(2)) % q2
    out = [np.zeros((len(p), d + 1), np.int64)]
    out[0][:, 0] = 1
    for k in range(d):
        now = np.roll(out[k], 1, axis=1) - h[:, k, k, None] * out[k] % q2
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            now -= (h[:, i, k] * below % p)[:, None] * out[i] % q2
        out.append(now % q2)
    return out[d]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Elementary symmetric sums ``e_0 .. e_d`` of the roots: ``det(x - m) = sum (-1)**k e_k x**(d - k)``.

    The roots are not negative, so ``sum e_k <= (1 + trace / d)**d`` bounds the product of primes.
    """
    import pyarrow as pa

    d, trace = len(m), int(sum(m[k, k] for k in range(len(m))))
    moduli = primes(d * (1 + trace // d).bit_length() + 2)
    each = -(-len(moduli) // min(len(moduli), spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for a in batch.column(0).to_pylist():
                mine = moduli[a : a + each]
                if mine:
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(polynomials(m, mine).tolist())], names=["p", "c"])

    tasks = spark.range(0, len(moduli), each, -(-len(moduli) // each))
    rows = {r["p"]: r["c"] for r in tasks.mapInArrow(run, "p long, c array<long>").collect()}
    product, out = math.prod(moduli), []
    part = [(q, (product // q) * pow(product // q, -1, q)) for q in moduli]
    for k in range(d + 1):
        out.append((-1) ** k * sum(rows[q][d - k] * w for q, w in part) % product)
    return out


def _beyond(e: list[int], a: int, s: int) -> int:
    """Number of roots greater than ``a / 2**s``: the sign changes after the shift, exact since all roots are real."""
    r = len(e) - 1
    c = [(-1) ** (r - k) * e[r - k] << (s * (r - k)) for k in range(r + 1)]  # from x**0 up, scaled
    for i in range(r):
        for k in range(r - 1, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def isolate(e: list[int], most: int) -> list[tuple[int, int, int, int]]:
    """``(low, high, s, roots)``: disjoint intervals ``(low, high] / 2**s``, highest first, holding the largest ``most`` roots
    and one root each, or several that ``CLUSTER`` bits don't tell apart.  ``e`` ends with its last coefficient that is not 0."""
    high = 1 << int(e[1]).bit_length()
    todo, out, have = [(0, high, 0, len(e) - 1, 0)], [], 0
    while todo and have < most:
        low, high, s, n_low, n_high = todo.pop()
        n = n_low - n_high
        if n == 0:
            continue
        if low and (n == 1 or (high - low) << CLUSTER <= high):
            out.append((low, high, s, n))
            have += n
            continue
        low, high, s = low << 1, high << 1, s + 1
        mid = (low + high) // 2
        n_mid = _beyond(e, mid, s)
        todo += [(low, mid, s, n_low, n_mid), (mid, high, s, n_mid, n_high)]  # the upper half is popped first
    return out


def _value(e: list[int], a: int, s: int) -> int:
    """``2**(s r)`` times the polynomial at ``a / 2**s``."""
    out, r = 0, len(e) - 1
    for k in range(r + 1):
        out = out * a + ((-1) ** k * e[k] << (s * k))
    return out


def narrow(e: list[int], low: int, high: int, s: int, roots: int) -> Fraction:
    """The root, or the middle of the roots, of an interval of ``isolate``."""
    if roots == 1:
        above = _value(e, high, s)
        if above == 0:
            return Fraction(high, 1 << s)
        while (high - low) << PRECISION > high:
            low, high, s = low << 1, high << 1, s + 1
            mid = (low + high) // 2
            v = _value(e, mid, s)
            if v == 0:
                return Fraction(mid, 1 << s)
            low, high = (low, mid) if (v > 0) == (above > 0) else (mid, high)
    return Fraction(low + high, 2 << s)


def _orthonormal(block: list[np.ndarray]) -> list[np.ndarray]:
    """Gram-Schmidt, twice over, in fixed point of ``BITS`` bits."""
    out: list[np.ndarray] = []
    for v in block:
        top = max(abs(int(x)) for x in v)
        v = np.array([(int(x) << BITS) // max(top, 1) for x in v], object)
        for _ in range(2):
            for u in out:
                v = v - (u * (int((u * v).sum()) >> BITS) >> BITS)
        size = max(math.isqrt(int((v * v).sum())), 1)
        out.append(np.array([(int(x) << BITS) // size for x in v], object))
    return out


def null_vectors(m: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal vectors that ``m - root`` brings nearest to zero, one a row, as doubles."""
    d = len(m)
    shift = BITS - int(sum(m[k, k] for k in range(d))).bit_length()  # entries below 2**BITS, so root and m keep their bits
    scale = lambda x: (x.numerator << shift) // x.denominator if shift >= 0 else x.numerator // (x.denominator << -shift)
    a = np.array([[scale(Fraction(int(x))) for x in row] for row in m], object)
    a[np.arange(d), np.arange(d)] -= scale(root)
    order, lower = np.arange(d), np.zeros((d, d), object)
    for k in range(d):
        at = k + int(np.argmax(np.abs(a[k:, k])))
        for x in (a, lower):
            x[[k, at]] = x[[at, k]]
        order[[k, at]] = order[[at, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # a root met exactly: the smallest step away from it
        if k + 1 < d:
            lower[k + 1 :, k] = [(int(x) << BITS) // a[k, k] for x in a[k + 1 :, k]]
            a[k + 1 :, k:] -= lower[k + 1 :, k, None] * a[None, k, k:] >> BITS

    def solve(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for k in range(d - 1):
            y[k + 1 :] -= lower[k + 1 :, k] * y[k] >> BITS
        x = np.zeros(d, object)
        for k in range(d - 1, -1, -1):
            x[k] = ((int(y[k]) - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> BITS)) << BITS) // a[k, k]
        return x

    start = np.random.default_rng(d).integers(-(1 << 40), 1 << 40, (count, d))
    block = _orthonormal([np.array([int(x) << (BITS - 40) for x in row], object) for row in start])
    for _ in range(ROUNDS):
        block = _orthonormal([solve(v) for v in block])
    out = np.array([[int(x) / (1 << BITS) for x in v] for v in block])
    sign = np.sign(out[np.arange(count), np.abs(out).argmax(1)])
    return out * sign[:, None]


@dataclass
class Model:
    n: int
    sums: np.ndarray  # Python integers, without the constant of the entries
    vectors: np.ndarray  # component x dimension
    values: np.ndarray  # eigenvalues of the covariance
    explained: np.ndarray
    error: float = 0.0

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """``x - S / n``, and the whole sums of ``(n x - S)**2``."""
        reach = self.n * int(np.abs(y).max(initial=0)) + max(abs(int(s)) for s in self.sums)
        whole = (np.int64 if reach < 1 << 62 else object)
        part = (y.astype(np.int64) if whole is np.int64 else _exact(y)) * self.n - self.sums.astype(whole)
        middle = (part / self.n).astype(np.float64)
        if y.shape[1] * reach * reach >= 1 << 62:
            part = part.astype(object)
        return middle, [int(s) for s in (part * part).sum(axis=1)]

    def project(self, middle: np.ndarray) -> np.ndarray:
        return middle @ (self.vectors / np.sqrt(self.values)[:, None]).T


def _component_rows(spark: SparkSession, m: np.ndarray, most: int) -> list[tuple[Fraction, np.ndarray]]:
    """The largest roots, not zero, with their null vectors; at most ``most``, falling."""
    import pyarrow as pa

    e = characteristic(spark, m)
    while e[-1] == 0:
        e.pop()  # roots of zero
    if len(e) == 1:
        return []
    found = isolate(e, most)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root = narrow(e, *found[k])
                vectors = null_vectors(m, root, found[k][3])
                n = len(vectors)
                cols = [pa.array([k] * n), pa.array([str(root)] * n), pa.array(range(n)), pa.array(vectors.tolist())]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "root", "place", "v"])

    tasks = spark.range(0, len(found), 1, len(found))
    rows = tasks.mapInArrow(run, "k long, root string, place long, v array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["k"], r["place"]))[:most]
    return [(Fraction(r["root"]), np.array(r["v"])) for r in rows]


def fit(different: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """By length the model of the fit list: ``different`` holds each integer vector ``y`` once."""
    spark = different.sparkSession
    models: dict[int, Model] = {}
    for d, g in sorted(scatter(different).items()):
        n, sums = int(g[0, 0]), g[0, 1:]
        m = g[1:, 1:] * n - np.outer(sums, sums)
        trace = int(sum(m[k, k] for k in range(d)))
        found = _component_rows(spark, m, min(components, d)) if trace else []
        if found:
            models[d] = Model(
                n, sums, np.stack([v for _, v in found]),
                np.array([float(r / (n * n)) for r, _ in found]), np.array([float(r / trace) for r, _ in found]),
            )
    errors = _identity_errors(different, models) if models else {}
    for d, error in errors.items():
        models[d].error = error
    return models


def _identity_errors(different: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    import pyarrow as pa

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, y in _matrices(batch.column(0)):
                if d in models:
                    w = models[d].project(models[d].centred(y)[0])
                    w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                    own[d] = own.get(d, 0) + w.T @ w
        for d, total in own.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            cols = [pa.array([d] * total.size, pa.int64()), pa.array(i), pa.array(j), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "i", "j", "v"])

    sums = different.select("y").mapInArrow(run, "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    out = {}
    tables: dict[int, np.ndarray] = {d: np.zeros((len(x.values) + 1,) * 2) for d, x in models.items()}
    for r in sums.collect():
        tables[r["d"]][r["i"], r["j"]] = r["v"]
    for d, t in tables.items():
        mean = t[0, 1:] / t[0, 0]
        out[d] = float(np.abs(t[1:, 1:] / t[0, 0] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS
) -> DataFrame:
    """Per row that takes part and component: ``id, component, n, deviation, whitened, explained, identity_error,
    deviation_digits``."""
    import pyarrow as pa

    prepare(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("i"), integers(F.col(vec_col), scale).alias("y")).where(F.col("y").isNotNull())
    with scratch(vectors.sparkSession):
        models = fit(cut_lineage(rows.select("y").distinct()), components)

    def run(batches):
        for batch in batches:
            for d, at, y in _matrices(batch.column(1)):
                model = models.get(d)
                if model is None:
                    continue
                middle, deviation = model.centred(y)
                w = model.project(middle)
                k = w.shape[1]
                times = lambda x, t: pa.array(x, t).take(pa.array(np.repeat(np.arange(len(x)), k)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(w.size, model.n)),
                        times([x if x < 1 << 63 else None for x in deviation], pa.int64()),
                        pa.array(w.ravel()),
                        pa.array(np.tile(model.explained, len(at))),
                        pa.array(np.full(w.size, model.error)),
                        times([str(x) for x in deviation], pa.string()),
                    ],
                    names=["i", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
                )

    schema = f"i {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    return rows.mapInArrow(run, schema).withColumnRenamed("i", id_col)
