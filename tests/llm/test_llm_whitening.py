import numpy as np
import pytest
from hydromelt.llm import feast, whitening

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def frame(spark):
    def make(vectors):
        rows = [v if isinstance(v, tuple) else (i, v) for i, v in enumerate(vectors)]
        return spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows],
                                     "vec_id long, embedding array<float>, n int, whitened double, x int").repartition(3)
    return make


def brute(vectors):
    """n, deviation by vector, |whitened| by vector, explained: from exact integers and numpy's dense solver."""
    x = [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    centre = np.array([s / n for s in sums])
    away = np.array(fit, float) - centre
    values, turn = np.linalg.eigh(away.T @ away / n)
    values, turn = values[::-1][:4], turn[:, ::-1][:, :4]
    white = (np.array(x, float) - centre) @ turn / np.sqrt(values)
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], white, values / (away ** 2).sum() * n


def test_equals_the_dense_solver(frame):
    chance = np.random.default_rng(3)
    vectors = (chance.standard_normal((300, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    vectors += vectors[:50] * 3  # copies count once in the fit, and come back each
    n, deviation, white, explained = brute(vectors)
    rows = whitening.whiten(frame(vectors)).collect()
    assert len(rows) == 4 * len(vectors) and {r["n"] for r in rows} == {n} == {300}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in rows)
    signs = {k: {bool(np.sign(r["whitened"]) == np.sign(white[r["vec_id"]][k - 1])) for r in rows if r["component"] == k}
             for k in range(1, 5)}
    assert all(len(found) == 1 for found in signs.values())
    for r in rows:
        k = r["component"] - 1
        assert abs(r["whitened"]) == pytest.approx(abs(white[r["vec_id"]][k]), rel=1e-9, abs=1e-9)
        assert r["explained"] == pytest.approx(explained[k], rel=1e-12) and r["identity_error"] < 1e-12


def test_odd_rows(frame):
    chance = np.random.default_rng(4)
    good = chance.standard_normal((40, 3)).astype(np.float32).tolist()
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [NAN, 1.0, 2.0]), (104, [1.0, INF, 2.0]), (105, [1.0, 2.0]),
           (106, [-INF, 0.0, 0.0]), (None, good[0]), (5, good[5]), (107, [-0.0, 0.0, 0.001])]
    rows = whitening.whiten(frame([*enumerate(good), *odd])).collect()
    ids = sorted((r["vec_id"] if r["vec_id"] is not None else -1) for r in rows if r["component"] == 1)
    assert ids == sorted([*range(40), -1, 5, 107]) and len(rows) == 3 * 43 and {r["n"] for r in rows} == {41}
    assert rows[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_no_rows_no_variance_and_huge_entries(spark, frame):
    assert whitening.whiten(frame([]).limit(0)).count() == 0
    assert whitening.whiten(frame([None, [NAN]])).count() == 0
    assert whitening.whiten(frame([[1.0, 2.0]] * 5)).count() == 0
    flat = whitening.whiten(frame([[1.0, 2.0], [2.0, 2.0], [3.0, 2.0]])).collect()
    assert {r["component"] for r in flat} == {1} and {r["explained"] for r in flat} == {1.0}
    assert len(whitening.whiten(frame([[1e38, 1.0], [-1e38, 2.0], [0.5, 3e38]])).where("deviation is null").collect()) > 0


def test_sums_are_exact(frame):
    rows = whitening.usable_rows(frame([[float(2 ** 54), -1.0], [-float(2 ** 54) + 2.0 ** 31, 0.5], [1.0, 1.0]]), "vec_id", "embedding")
    vectors = [r["x"] for r in rows.collect()]
    assert whitening.exact_sums(rows, 2) == (3, [sum(v[i] for v in vectors) for i in range(2)])


def matrix(values, seed=0):
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    return turn @ np.diag(values) @ turn.T


@pytest.mark.parametrize("values", [
    [5.0] * 5 + [1.0] * 20, [5.0] + [3.0] * 6 + [1.0] * 20, [5 - 1e-7 * i for i in range(6)] + [1.0] * 20, list(range(40)), [2.0], [1.0, 0, 0]])
def test_contour_integration_finds_all(spark, values):
    """Ties across the last place, close values, and fewer values than wanted."""
    m = matrix(np.array(values, float))
    found, vectors = feast.leading(spark, m, 4)
    want = np.linalg.eigvalsh(m)[::-1][:4]
    assert found == pytest.approx(want, abs=1e-12 * max(values))
    assert np.abs(m @ vectors - vectors * found).max() <= 1e-12 * max(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13


def test_counts_equal_eigenvalues():
    for seed in range(5):
        m = matrix(np.random.default_rng(seed).standard_normal(15), seed)
        shifts = np.linspace(-3, 3, 50)
        assert feast.count_above(*feast.tridiagonal(m), shifts).tolist() == [
            int((np.linalg.eigvalsh(m) > s).sum()) for s in shifts]


def test_query_over_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, white, explained = brute([r["embedding"] for r in rows])
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    found = whitening.op11_feast_whitening(spark, sf_dir).collect()
    assert len(found) == 4 * len(rows)
    for r in found:
        assert r["deviation"] == deviation[place[r["vec_id"]]] and r["n"] == n and r["identity_error"] <= 1e-10
        assert abs(r["whitened"]) == pytest.approx(abs(white[place[r["vec_id"]]][r["component"] - 1]), abs=1e-9)
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-10)
