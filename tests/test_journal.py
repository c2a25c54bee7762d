"""Logs cut anywhere, locked records, blocks as a format, a watched folder."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import journal, sealed
from lodestone.sources import blocks
from lodestone.sources.block_format import BlockSource, blocks_of
from lodestone.streaming import inbox

LOG = [
    (1, "a", "begin", None, None), (2, "a", "write", "x", "1"), (3, "b", "write", "y", "2"), (4, "a", "write", "x", "é3"), (5, "a", "commit", None, None),
    (6, "b", "rollback", None, None), (7, "c", "write", "x", None), (8, "d", "write", "z", "4"), (9, "d", "commit", None, None), (10, "c", "commit", None, None),
    (11, "d", "write", "z", "late"), (12, "e", "write", "y", "open"),
]


def test_a_log_cut_at_every_byte(spark):
    """Each cut is a store of its own: its state is that of the commits that are whole in it."""
    whole = "".join(json.dumps(dict(zip(("seq", "tx", "kind", "target", "content"), row, strict=True))) + "\n" for row in LOG).encode()
    lines, expected = [], {}
    for cut in range(len(whole) + 1):
        some = whole[:cut].decode("utf-8", "replace").split("\n")
        lines += [(cut, n, line) for n, line in enumerate(some)]
        done = {tx for seq, tx, kind, *_ in LOG[: sum(map(_whole, some))] if kind == "commit"}
        state = {"y": "old", "w": "kept"}
        for tx in ("a", "d", "c"):
            if tx in done:
                state |= {"a": {"x": "é3"}, "d": {"z": "4"}, "c": {"x": None}}[tx]
        expected |= {(cut, k): v for k, v in state.items() if v is not None}
    base = spark.createDataFrame([(c, k, v) for c in range(len(whole) + 1) for k, v in (("y", "old"), ("w", "kept"), ("n", None))], "store int, target string, content string")
    log = journal.parsed(spark.createDataFrame(lines + lines[::3], "store int, at int, line string")).cache()
    once = journal.replayed(base, log)
    assert {(r.store, r.target): r.content for r in once.collect()} == expected
    twice = journal.replayed(once, log)
    assert sorted(map(tuple, twice.collect())) == sorted((s, t, c) for (s, t), c in expected.items())
    assert log.where("torn").select("store").distinct().count() > len(whole) - 2 * len(LOG) - 2


def _whole(line):
    try:
        return bool(json.loads(line))
    except ValueError:
        return False


def test_sealed(spark):
    keys = spark.createDataFrame([("k1", b"0" * 16), ("k2", b"1" * 32), ("k3", b"2" * 16)], "key_id string, key binary")
    rows = spark.createDataFrame([(1, "one", "k1"), (2, "zwei ß", "k2"), (3, None, "k1"), (4, "", "k1"), (5, "five", "k1"), (6, "six", "k1")], "id long, content string, key_id string")
    held = spark.createDataFrame(sealed.seal(rows, keys, "key_id").collect(), "id long, key_id string, sealed binary")
    box = {r.id: r.sealed for r in held.collect()}
    assert box[3] is None and b"one" not in bytes(box[1]) and len(set(map(bytes, filter(None, box.values())))) == 5
    changed = bytes(box[6][:-1]) + bytes([box[6][-1] ^ 1])
    bad = held.select("id", "key_id", F.when(F.col("id") == 5, F.lit(bytes(box[1]))).when(F.col("id") == 6, F.lit(changed)).otherwise(F.col("sealed")).alias("sealed"))
    state = lambda df, k=keys: {r.id: (r.content, r.state) for r in sealed.opened(df, k).collect()}
    assert state(bad) == {1: ("one", "open"), 2: ("zwei ß", "open"), 3: (None, "empty"), 4: ("", "open"), 5: (None, "broken"), 6: (None, "broken")}
    wrong = spark.createDataFrame([("k1", b"9" * 16)], "key_id string, key binary")
    assert state(bad, wrong)[1] == (None, "broken") and state(bad, wrong)[2] == (None, "unknown key")
    moved = spark.createDataFrame(sealed.rotated(bad, keys, "k3").collect(), "id long, key_id string, sealed binary")
    assert {r.id: r.key_id for r in moved.collect()} == {1: "k3", 2: "k3", 3: "k1", 4: "k3", 5: "k1", 6: "k1"}
    assert state(moved) == state(bad)
    plan = sealed.seal(rows, keys, "key_id")._jdf.queryExecution().toString()
    assert "0000000000000000" not in plan and "30 30 30 30" not in plan
    with pytest.raises(Exception, match="no such key: k9"):
        sealed.seal(rows.withColumn("key_id", F.lit("k9")), keys, "key_id").collect()


GOOD = "intro\n[D-1]\nTitle: one: two\nTags:\n- a\n-  b \n  more\n\n[T-x.2]  \nEmpty:\nNote: é\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("blocks")
    (at / "sub").mkdir()
    (at / "a.md").write_text(GOOD)
    (at / "sub" / "b.md").write_bytes(GOOD.encode() + b"[Bad header\nText: lost\n[E-9]\nX: \xff1\r\n")
    (at / "c.md").write_text("")
    return at


def test_block_format(spark, folder):
    spark.dataSource.register(BlockSource)
    read = lambda **o: spark.read.format("blocks").options(**o).load(str(folder))
    rows = sorted((r.path.rsplit("/", 1)[1], r.block_id, r.line, r.fields, r._corrupt) for r in read().where("block_id IS NOT NULL").collect())
    assert rows[:2] == [("a.md", "D-1", 2, {"Title": "one: two", "Tags": "a\nb \nmore"}, None), ("a.md", "T-x.2", 9, {"Note": "é"}, None)]
    assert rows[2][:2] == ("b.md", "D-1") and rows[3][1:4] == ("E-9", 14, {"X": "�1"}) and len(rows) == 5
    assert [(r.line, r._corrupt) for r in read().where("_corrupt IS NOT NULL").select("line", "_corrupt").collect()] == [(12, "[Bad header\nText: lost")]
    assert read(mode="dropmalformed").count() == 5
    cut = read(most_bytes=40).where("block_id IS NULL").collect()
    assert sorted(r._corrupt for r in cut) == ["more than 40 bytes"] * 2
    for options in ({"mode": "FAILFAST"}, {"mode": "FAILFAST", "most_bytes": 40}, {"mode": "other"}):
        with pytest.raises(Exception, match="Bad header|more than 40|unknown mode"):
            read(**options).collect()


def test_block_format_agrees_with_the_parser(spark, folder):
    files = [(str(p), p.read_text(errors="replace")) for p in sorted(folder.rglob("a.md"))]
    plain = blocks.parse_blocks(spark.createDataFrame(files, "path string, content string")).collect()
    assert [(r.block_id, r.line) for r in sorted(plain, key=lambda r: r.line)] == [(b, n) for b, n, *_ in blocks_of(files[0][1])]


def test_a_watched_folder(spark, tmp_path, monkeypatch):
    """Restarts, and a batch that fails once it has written, neither lose nor double a file."""
    at, out, state, kept = (str(tmp_path / n) for n in ("in", "out", "state", "kept"))
    (tmp_path / "in").mkdir()

    def put(*names):
        for n in names:
            (tmp_path / "in" / f"{n}.md").write_text(f"[D-{n}]\nTitle: {n}\n[D-{n}b]\n")

    def run(**more):
        query = inbox.watch(spark, f"file://{at}", out, state, files_at_once=2, **more)
        query.awaitTermination(90)
        return query.exception()

    ids = lambda: sorted(r.block_id for r in inbox.blocks_read(spark, out).collect())
    put("1", "2", "3")
    assert run() is None and ids() == sorted(f"D-{n}{b}" for n in "123" for b in ("", "b"))
    put("4")
    whole, failed = inbox.parse_blocks, []

    class Failing:
        def __init__(self, df):
            self.df = whole(df)

        @property
        def write(self):
            self.df.write.mode("overwrite").parquet(f"{out}/batch=2")
            failed.append(1)
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(inbox, "parse_blocks", Failing)
    try:
        run()
    except Exception as e:
        assert "lost after writing" in str(e)
    assert failed
    monkeypatch.setattr(inbox, "parse_blocks", whole)
    put("5")
    run()
    run()
    assert ids() == sorted(f"D-{n}{b}" for n in "12345" for b in ("", "b"))
    twin = blocks.read_blocks(spark, at)
    assert sorted(r.block_id for r in twin.collect()) == ids()
