import numpy as np
import pytest

from kireme.plans import network as N
from kireme.plans import steps as S

C, SHAPE = N.Config(2, 3, 4, 9, 1), S.Shape(2, 3, 4)
EXAMPLES = [
    (1, [[2], [3, 4], [0], [5]], [0, 5]), (0, [[3, 4], [2, 3, 3], [1], [8]], [3]), (1, [[0], [0], [6], [2]], []), (0, [[2], [2], [2], [2]], [1, 2, 11]),
]


def batch():
    return N.Batch.of([s for _, s, _ in EXAMPLES], [f for _, _, f in EXAMPLES], [y for y, _, _ in EXAMPLES], 12)


def examples(spark, *models):
    return spark.createDataFrame([(m, y, s, f) for m in models for y, s, f in EXAMPLES], "model string, label int, slots array<array<int>>, features array<int>")


def arrays(df, like, model):
    """Parameters (or gradients) of a table as numpy, zero where rows lack, and the feedback."""
    out, feedback = N.Parameters(*(np.zeros_like(getattr(like, n), dtype=float) for n in N.Parameters.NAMES)), None
    for r in df.filter(f"model = '{model}'").collect():
        if r.name == "w1":
            k, h = divmod(r.at, SHAPE.hidden)
            out.w1[h, k * SHAPE.dim : (k + 1) * SHAPE.dim] = r.vec
        elif r.name == "wdict":
            out.wdict[:, r.at] = r.vec
        elif r.name == "emb":
            out.emb[r.at] = r.vec
        elif r.name == "feedback":
            feedback = np.array(r.vec)
        elif r.name != "loss":
            getattr(out, r.name)[:] = r.vec
    return out, feedback


def close(a, b, tolerance=1e-5):
    for n in N.Parameters.NAMES:
        assert np.allclose(getattr(a, n), getattr(b, n), atol=tolerance), n


def start(seed):
    p = N.Parameters.init(C, seed)
    p.b1 += 0.05
    return p


def test_forward_and_gradients_equal_numpy(spark):
    p, q = start(1), start(2)
    table = S.parameter_table(spark, p, "p").unionByName(S.parameter_table(spark, q, "q"))
    grads = S.gradients(examples(spark, "p", "q"), table, SHAPE).cache()
    for name, own in (("p", p), ("q", q)):
        want, rows, loss = N.backward(own, batch())
        close(arrays(grads, own, name)[0], want)
        assert sorted(r.at for r in grads.filter(f"model = '{name}' and name = 'emb'").collect()) == rows.tolist()
        assert abs(grads.filter(f"model = '{name}' and name = 'loss'").first().vec[0] - loss) < 1e-6
    passed = S.forward(examples(spark, "p"), table, SHAPE).collect()
    x, a, y, _ = N.forward(p, batch())
    assert np.allclose([r.y for r in passed], y, atol=1e-5) and np.allclose([r.a for r in passed], a, atol=1e-5)
    assert np.allclose([np.concatenate(r.x) for r in passed], x, atol=1e-6)


@pytest.mark.parametrize("decay", [0.0, 0.1])
def test_optimizers_equal_numpy(spark, decay):
    p = start(3)
    table = S.parameter_table(spark, p)
    moments, adam, sgd = S.adam_start(table), N.Adam(0.05, decay=decay), p.copy()
    for _ in range(3):
        grads = S.gradients(examples(spark, ""), table, SHAPE)
        table, moments = (df.cache() for df in S.adam_step(table, moments, grads, 0.05, decay=decay))
        g, rows, _ = N.backward(p, batch())
        adam.step(p, g, rows)
    close(arrays(table, p, "")[0], p, 1e-4)
    first = S.parameter_table(spark, sgd)
    moved = S.sgd_step(first, S.gradients(examples(spark, ""), first, SHAPE), 0.5)
    g, rows, _ = N.backward(sgd, batch())
    N.Sgd(0.5).step(sgd, g, rows)
    close(arrays(moved, sgd, "")[0], sgd)


@pytest.mark.parametrize("rule", ["hybrid", "pure"])
def test_diffusion_equals_numpy(spark, rule):
    p = N.signed_start(C, 4)
    d = N.Diffusion(rule, 0.5, True, 0.1)
    table = S.signed_start(S.parameter_table(spark, N.Parameters.init(C, 4)), C.hidden)
    own, feedback = arrays(table, p, "")
    close(own, p)
    assert np.allclose(feedback, d.weights(C.hidden))
    for _ in range(2):
        table = S.diffusion_step(examples(spark, ""), table, SHAPE, rule, 3.0, 0.5, 0.1).cache()
        before = p.w2.copy()
        g, rows, _ = d.update(p, batch())
        N.Sgd(3.0).step(p, g, rows)
        pinned = N.project(p)
        d.track(p, before)
    own, feedback = arrays(table, p, "")
    close(own, p, 1e-4)
    assert np.allclose(feedback, d.feedback, atol=1e-4)
    state = S.diffusion_state(table).first()
    assert state.pinned == pinned and abs(state.gap - d.gap(p)) < 1e-4


def test_pure_rule_by_hand():
    p = N.Parameters(np.array([[0, 0], [0, 0], [1, 1]], np.float32), np.array([[0.25] * 4, [-0.125] * 4], np.float32), np.zeros((2, 0), np.float32), np.zeros(2, np.float32), np.array([2, -4], np.float32), np.zeros(1, np.float32))
    b = N.Batch.of([[[2], [2]], [[1, 2], [0]]], [[], []], [1, 0], 0)
    g, _, _ = N.Diffusion("pure", 0.5).update(p, b)
    y = N.forward(p, b)[2]
    e = (1 / (1 + np.exp(-y)) - np.array([1, 0])) / 2
    # both slots of the first example and half a slot of the second hold row 2; signs of two dimensions are + and -
    assert np.allclose(g.emb[2], 0.5 * (2 * e[0] + e[1] / 2) * np.array([1, -1]))
    assert np.allclose(g.emb[0], 0.5 * e[1] * np.array([1, -1])) and np.allclose(g.emb[1], 0.25 * e[1] * np.array([1, -1]))


def test_no_examples(spark):
    table = S.parameter_table(spark, start(5))
    empty = examples(spark, "").filter("label > 1")
    grads = S.gradients(empty, table, SHAPE)
    assert grads.count() == 0 and S.sgd_step(table, grads).exceptAll(table).count() == 0


def test_equal_examples_are_one_row_with_their_number(spark, tmp_path):
    from kireme import network_queries as Q

    p = start(3)
    table, each = S.parameter_table(spark, p, "p"), examples(spark, *["p"] * 3).unionByName(examples(spark, "p").filter("label = 1"))
    one = S.merged(each)
    assert sorted(r.times for r in one.collect()) == [3, 3, 4, 4] and sorted(r.times for r in S.merged(one.unionByName(one)).collect()) == [6, 6, 8, 8]
    for rule in ("backpropagation", "hybrid"):
        own = S.signed_start(table, SHAPE.hidden)
        want, got = ({(r.name, r.at): r.vec for r in S.gradients(x, own, SHAPE, rule).collect()} for x in (each, one))
        assert want.keys() == got.keys() and all(np.allclose(want[k], got[k], atol=1e-12) for k in want)
    spark.createDataFrame([(i, i % 3, "Ab a b") for i in range(50)], "conv_id long, turn int, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    rows = Q.turn_examples(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and {r.times for r in rows} == {50}
