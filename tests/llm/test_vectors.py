"""Codes and whitening of vectors against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from mailquarry.llm import codes, limbs, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, part int"
NAN, INF = float("nan"), float("inf")


def vectors(n, size, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, size)) @ rng.normal(size=(size, size)) / 4 + 0.3).astype(np.float32)


def frame(spark, x, extra=()):
    """Extra columns have the names that operators use inside; ids go down, every third label is null."""
    n = len(x)
    rows = [(n - i, [float(c) for c in v], None if i % 3 == 0 else i % 5, "x", 1) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)


UNUSABLE = [(901, None, 1, "x", 1), (902, [1.0, None] + [0.0] * 6, 1, "x", 1), (903, [NAN] * 8, 1, "x", 1), (904, [INF] * 8, 2, "x", 1), (905, [], 1, "x", 1), (906, [1.0] * 5, 1, "x", 1)]


def test_products_by_limbs():
    rng = random.Random(1)
    for high_a, high_b, inner in ((3, 3, 1), (1 << 24, 1 << 24, 16), (1 << 40, 1 << 14, 32), (1 << 29, 1 << 28, 33), (1 << 13, 1 << 13, 4096)):
        a = np.array([[rng.randint(-high_a, high_a) for _ in range(inner)] for _ in range(5)])
        b = np.array([[rng.randint(-high_b, high_b) for _ in range(3)] for _ in range(inner)])
        assert (limbs.product(a, b) == a.astype(object) @ b.astype(object)).all()
        bits = limbs.limb_bits(inner)
        assert 2 * bits + (inner - 1).bit_length() <= 53
        assert all(np.abs(x).max() <= 1 << bits for x in limbs.limbs(a, bits))
    with pytest.raises(OverflowError):
        limbs.product(np.full((1, 4), 1 << 40), np.full((4, 1), 1 << 40))


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Row by row in whole numbers of any size."""
    rows = sorted(((i, [int(np.floor(scale * float(c))) for c in v], label) for i, v, label in rows), key=lambda r: (r[0], r[1]))
    width = len(rows[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, members in own.items():
                books[p][e] = [sum(m[j] for m in members) // len(members) for j in range(width)]
    got = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in g) for g in got]
    by_label = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((r[0], "".join(f"{e:02x}" for _, e in g), e, by_label[r[2]], sha) for r, g, e in zip(rows, got, errors, strict=True))


@pytest.mark.parametrize("stretch", [1, 3000])
def test_codes(spark, stretch):
    x = vectors(400, 8) * stretch
    x[350:] = x[:50]                                     # repeated vectors: ties
    df = frame(spark, x, UNUSABLE)
    want = plain_codes([(len(x) - i, v, None if i % 3 == 0 else i % 5) for i, v in enumerate(x)])
    assert sorted(map(tuple, codes.compress(df).collect())) == want


def test_codes_of_few_and_no_vectors(spark):
    df = frame(spark, vectors(5, 8))
    got = codes.compress(df).collect()
    assert [r.error for r in got] == [0] * 5 and len({r.code for r in got}) == 5         # every vector is its own entry
    same = frame(spark, np.ones((6, 8), np.float32))
    assert {r.code for r in codes.compress(same).collect()} == {"00000000"}
    repeated = df.unionByName(df)
    assert codes.compress(repeated).count() == 10
    null_ids = spark.createDataFrame([(None, [1.0] * 6, None, "x", 1), (None, [2.0] * 6, None, "x", 1)], SCHEMA)
    assert sorted(r.code for r in codes.compress(null_ids).collect()) == ["00000000", "01010100"]          # the last part is zeros
    for rows in (df.where("false"), df.where("false").unionByName(spark.createDataFrame(UNUSABLE[:5], SCHEMA))):
        assert codes.compress(rows).count() == 0
    assert codes.compress(df.where("false")).columns == codes.compress(df).columns


def plain_covariance(x):
    x = x.astype(object)
    n, total = len(x), x.sum(0)
    y = n * x - total
    return np.array((y.T @ y) / n ** 3, float), n, total, y


def test_whitening(spark):
    raw = vectors(300, 40)
    df = frame(spark, raw, [(901, None, 1, "x", 1), (902, [None] * 40, 1, "x", 1), (903, [NAN] * 40, 1, "x", 1)])
    got = whitening.whiten(df).toPandas()
    x = np.floor(64 * raw.astype(float)).astype(np.int64) + 1_000_000
    v, n, total, y = plain_covariance(x)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:32], vector[:, ::-1][:, :32]
    want = (x - np.array(total / n, float)) @ vector / np.sqrt(value)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[len(raw) - i for i in range(len(raw))]].to_numpy()
    sign = np.sign((table * want).sum(0))
    assert np.abs(table - want * sign).max() < 1e-7
    assert sorted(got.component.unique()) == list(range(1, 33)) and set(got.n) == {300}
    deviation = got.drop_duplicates("vec_id").set_index("vec_id").deviation
    assert all(deviation[len(raw) - i] == int((r * r).sum()) for i, r in enumerate(y))
    share = got.drop_duplicates("component").set_index("component").explained
    assert np.allclose([share[k + 1] for k in range(32)], value / np.trace(v), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert np.abs(np.cov(table.T, bias=True) - np.eye(32)).max() < 1e-9


def test_whitening_without_variance(spark):
    """A fixed dimension, equal dimensions, fewer rows than dimensions, one row, no rows."""
    raw = vectors(50, 4)
    raw = np.concatenate([raw, raw[:, :1], np.ones((50, 1), np.float32)], 1)
    got = whitening.whiten(frame(spark, raw)).toPandas()
    zero = got[got.component > 4]
    assert len(got) == 300 and (zero.whitened == 0).all() and np.allclose(zero.explained, 0, atol=1e-12)
    wide = whitening.whiten(frame(spark, vectors(3, 40))).toPandas()
    assert len(wide) == 96 and (wide[wide.component > 2].whitened == 0).all() and np.isfinite(wide.whitened).all()
    one = whitening.whiten(frame(spark, vectors(1, 8))).toPandas()
    assert (one.whitened == 0).all() and (one.deviation == 0).all() and (one.explained == 0).all()
    for rows in (frame(spark, raw).where("false"), spark.createDataFrame(UNUSABLE[:5], SCHEMA)):
        assert whitening.whiten(rows).count() == 0


@pytest.mark.parametrize("values", [np.linspace(1, 100, 48), np.r_[np.ones(20), np.linspace(2, 50, 28)], np.r_[np.ones(20) + 1e-7 * np.arange(20), np.linspace(2, 50, 28)],
                                    np.zeros(48), np.r_[np.full(24, 1e-6), np.full(24, 1e6)]])
def test_refined_eigenvectors(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(48, 48)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    _, rough = np.linalg.eigh(a.astype(np.float32))
    value, x = whitening.refined(a, rough)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(48)).max() < 1e-16
    assert np.abs(a @ x - x * value).max() < 1e-16 * size * 48
    assert np.abs(rough.T @ rough - np.eye(48)).max() > 1e-8 or not values.any()             # what single precision leaves


def test_deviation_beyond_64_bits():
    z = np.array([[1 << 20, -5], [3, 4]])
    n, offset = 10 ** 9, [7, -11]
    want = [sum((n * a - r) ** 2 for a, r in zip(row, offset, strict=True)) for row in z.tolist()]
    assert whitening.deviations(z, n, offset) == want and want[0] > 1 << 63
