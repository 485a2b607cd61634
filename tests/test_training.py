import numpy as np
import pytest

from kireme.plans import network as N
from kireme.plans import training as T
from kireme.plans.segmenter import Segmenter
from kireme.sources.models import parse_neural, serialize_neural

C = N.Config(1, 3, 4, 5, 1)


def batch():
    return N.Batch.of([[[2], [3, 4]], [[3, 4], [2, 3]]], [[0, 5], [3]], [1, 0], 12)


def test_gradients():
    p, b, eps = N.Parameters.init(C, 1), batch(), 1e-3
    g, rows, _ = N.backward(p, b)
    assert rows.tolist() == [2, 3, 4]
    for name in N.Parameters.NAMES:
        x = getattr(p, name)
        for at in np.ndindex(x.shape):
            old = x[at]
            x[at] = old + eps
            up = N.forward(p, b)[3]
            x[at] = old - eps
            down = N.forward(p, b)[3]
            x[at] = old
            assert abs((up - down) / (2 * eps) - getattr(g, name)[at]) < 2e-3, name


def test_optimizers_touch_only_rows_of_the_batch():
    for opt in (N.Sgd(0.25), N.Adam(0.1)):
        p = N.Parameters.init(C, 1)
        before = p.copy()
        g, rows, loss = N.backward(p, batch())
        opt.step(p, g, rows)
        assert (p.emb[:2] == before.emb[:2]).all() and not (p.emb[2] == before.emb[2]).all()
        assert N.forward(p, batch())[3] < loss


def test_diffusion():
    p = N.Parameters(np.array([[0, 0], [0, 0], [1, 1]], np.float32), np.array([[0.25] * 4, [0.125] * 4], np.float32), np.zeros((2, 0), np.float32), np.zeros(2, np.float32), np.array([2, -4], np.float32), np.zeros(1, np.float32))
    b = N.Batch.of([[[2], [2]]], [[]], [1], 0)
    g, rows, loss = N.Diffusion().update(p, b)
    assert abs(loss - np.log(2)) < 1e-6 and g.b2[0] == -0.5 and g.w2.tolist() == [-0.5, -0.25]
    assert g.b1.tolist() == [-0.5, 0.5] and (g.w1[0] == -0.5).all() and (g.w1[1] == 0.5).all()
    assert np.allclose(g.emb[2], [-0.125, -0.125])
    same = p.copy()
    same.w2 = np.array([1, -1], np.float32)
    d, _, _ = N.Diffusion().update(same, b)
    e, _, _ = N.backward(same, b)
    assert all(np.allclose(getattr(d, n), getattr(e, n)) for n in N.Parameters.NAMES)
    assert N.polarity(4).tolist() == [1, 1, -1, -1] and N.polarity(3).tolist() == [1, -1, -1]
    p.w2 = np.array([-1, -4], np.float32)
    assert N.project(p) == 1
    f = N.Diffusion(learn=True, decay=0.1)
    first = np.linalg.norm(f.weights(2) - p.w2)
    before = p.w2.copy()
    p.w2 = p.w2 + 0.5
    f.track(p, before)
    assert np.isclose(np.linalg.norm(f.weights(2) - p.w2), first * 0.9)


def test_quantization():
    x = np.array([0.5, -1.0, 0.25], np.float32)
    s = N.max_abs_scale(x)
    assert np.abs(N.quantize_tensor(x, s) * s - x).max() <= s / 2 and N.max_abs_scale(np.zeros(3)) == 1.0


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, tags array<tinyint>")


def test_examples(spark):
    full = frame(spark, [("あいうえ", [0, 1, 0])])
    rows = T.build_examples(full, [0x3042], [], 1).collect()
    assert [r.label for r in rows] == [0, 1, 0]
    odd = frame(spark, [("が", [1]), ("がた", [0, 1]), ("あいう", [None, 1])])
    got = {r.status: r.n for r in T.example_statistics(T.build_examples(odd, [], [], 1)).collect()}
    assert got == {"conflict": 1, "example": 2, "unknown": 1}
    dicts = T.build_examples(frame(spark, [("かきを", [0, 1])]), [], [["かき"], ["を"]], 1).collect()
    assert [r.features for r in dicts] == [[5], [9, 12]]
    assert T.build_vocabulary(frame(spark, [("ああい", []), ("あうう", [])]), 2) == [0x3042, 0x3046]


@pytest.mark.parametrize("backend", ["mlp", "ed"])
def test_training_converges(spark, tmp_path, backend):
    rng = np.random.default_rng(9)
    words = ["あい", "うえお", "かき", "くけこ", "さし", "すせそ"]
    rows = []
    for _ in range(60):
        line = [words[i] for i in rng.integers(0, 6, 6)]
        tags = [int(j == len(w) - 1) for w in line for j in range(len(w))][:-1]
        rows.append(("".join(line), tags))
    data = frame(spark, rows).coalesce(2)
    vocab = T.build_vocabulary(data, 1)
    T.build_examples(data, vocab, [], 2).write.parquet(str(tmp_path / "x"))
    examples = spark.read.parquet(str(tmp_path / "x"))
    c = N.Config(2, 8, 16, len(vocab) + 2)
    o = T.Options(4, 12, 32, 10, 9, lr=5e-3, diffusion=N.Diffusion() if backend == "ed" else None)
    found = T.train(examples, examples, c, o)
    assert found.losses[-1] < found.losses[0] / 2 and found.metrics["f1"] > 0.99
    model = parse_neural(serialize_neural(T.export(examples, found.params, c, vocab, backend=backend)))
    words = [(w.start, w.end) for w in Segmenter(spark, model, "int32").transform(spark.createDataFrame([("かきあいうえお",)], "text string")).first().words]
    assert words == [(0, 6), (6, 12), (12, 21)]
    flips = T.sign_flips(data.select("text"), model).first()
    assert flips.flips <= flips.gaps * 0.001


def test_stream_and_commands(spark, tmp_path):
    from kireme import cli
    from kireme.plans.segmenter import space_model
    from kireme.streaming.segment import read_line_stream, segment_stream, write_line_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a b\nc/d\n")
    s = Segmenter(spark, space_model(), "int32")
    q = write_line_stream(segment_stream(s, read_line_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a \\  b", "c\\/d"]
    (tmp_path / "m.mod").write_bytes(serialize_neural(space_model()))
    assert cli.main(["predict", "--model", str(tmp_path / "m.mod"), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "p")]) == 0
    assert cli.main(["predict", "--model", str(tmp_path / "none"), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "p2")]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["predict"])
    assert e.value.code == 2
    assert cli.main(["extract-dict", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "d"), "--min-count", "1"]) == 0
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["a", "b", "c\\/d"]


def test_examples_are_dealt_anew_each_epoch(spark):
    from pyspark.sql import functions as F

    table = spark.range(600).withColumn("label", F.lit(1)).repartition(4).withColumn("id", F.monotonically_increasing_id())
    deal = lambda epoch: {r.id: r.p for r in T.dealt(table, 4, 7, epoch).select("id", F.spark_partition_id().alias("p")).collect()}
    first, again, second = deal(1), deal(1), deal(2)
    assert first == again and set(first) == set(second) and len(first) == 600
    moved = sum(first[i] != second[i] for i in first)
    assert 350 < moved < 550 and set(first.values()) == set(second.values()) == {0, 1, 2, 3}
    assert T.dealt(table, 1, 7, 1) is table


def test_ordered_stream_keeps_what_came_before_a_bad_line(spark, tmp_path):
    from kireme.plans.segmenter import space_model
    from kireme.streaming.segment import read_ordered_stream, write_ordered_stream

    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    source.mkdir()
    s = Segmenter(spark, space_model(), "int32")

    def run():
        q = write_ordered_stream(s, read_ordered_stream(spark, str(source)), str(out), str(check))
        q.awaitTermination(60)
        return q

    read = lambda k: [x.replace(" \\  ", "_") for p in sorted((out / f"batch={k}").glob("part*")) for x in p.read_text().splitlines()]
    (source / "a.txt").write_text("".join(f"l{i} x\n" for i in range(200)))
    run()
    want = [f"l{i}_x" for i in range(200)]
    assert read(0) == want
    (source / "b.txt").write_bytes(b"one\ntwo\n\xff bad\nlast\n")
    for _ in range(2):
        with pytest.raises(Exception, match="invalid UTF-8 in line 3 of .*b.txt"):
            run()
        assert read(0) == want and read(1) == ["one", "two"]
    (source / "b.txt").write_bytes(b"one\ntwo\nmended\nlast\n")
    run()
    assert read(0) == want and read(1) == ["one", "two", "mended", "last"]
