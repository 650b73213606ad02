"""Parallel CSV reading against Python's csv module on the whole file."""

import csv
import io
import random

import pytest

from tidemark.sources import readers as A
from tidemark.sources.records import after_line, records


def plain(text, wanted):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    names, body = [n.strip().lower() for n in rows[0]], rows[1:]
    out = []
    for r in body:
        if len(r) > len(names):
            out.append(None)
        else:
            r = dict(zip(names, r, strict=False))
            out.append(tuple(r.get(w) or None for w in wanted))
    return out


def made(seed, rows, breaks):
    r = random.Random(seed)
    piece = lambda: r.choice(["a", "bc", " ", "é", "日本", "x,y", '"', '""', "\n" * breaks, "\r\n" * breaks, "it's", ",", "\n,\n" * breaks, "\n\"\n" * breaks])
    out = io.StringIO()
    w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
    w.writerow(["id", "text", "more"])
    for i in range(rows):
        w.writerow([i, "".join(piece() for _ in range(r.randint(0, 30))), "".join(piece() for _ in range(r.randint(0, 3)))] + (["too", "many"] if r.random() < 0.05 else []))
        if r.random() < 0.02:
            out.write("\n")
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    """Files are divided into ranges of 300 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "300")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("seed", range(4))
def test_divided_files_give_the_same_records(spark, tmp_path, small_ranges, seed):
    texts = {f"{seed}{k}.csv": made(10 * seed + k, 120, breaks) for k, breaks in enumerate([1, 1, 0])}
    texts["long.csv"] = 'id,text\n1,"' + "line\n" * 400 + '"\n2,x\n3,"' + 'q""\n' * 300 + '",\n'
    texts["open.csv"] = 'id,text\n1,b\n2,"never closed\n' + "more\n" * 200
    texts["odd.csv"] = 'id,text,more\n1,5" tall,b"c\n2,"a"b"c,d\n' * 40
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = records(spark, [str(tmp_path)], ["id", "more", "text", "none"])
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 40  # tasks grow with bytes
    by_file = {}
    for x in got.collect():
        by_file.setdefault(x.path.rsplit("/", 1)[1], []).append(None if x.bad else (x.c0, x.c1, x.c2, x.c3))
    key = lambda rows: sorted(map(str, rows))
    for name, text in texts.items():
        assert key(by_file[name]) == key(plain(text, ["id", "more", "text", "none"])), name


def test_whole_files_give_the_same_records(spark, tmp_path):
    text = made(99, 300, 1)
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b"id,text\n")
    got = [None if x.bad else (x.c0, x.c1) for x in records(spark, [str(tmp_path)], ["id", "text"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(text, ["id", "text"])))


def test_state_after_a_line():
    r = random.Random(1)
    for _ in range(3000):
        line = "".join(r.choice('ab,""') for _ in range(r.randint(0, 12)))
        for inside in (False, True):
            # one more field that is never closed leaves the reader at its end only if the line is at its own
            text = ('"' if inside else "") + line + "\nEND"
            rows = list(csv.reader(io.StringIO(text)))
            assert after_line(line + "\n", inside) == (rows[-1] != ["END"]), (line, inside)


def test_bad_lines_are_dropped_and_counted(spark, tmp_path):
    head = "user_screen_name,tweet_time,tweet_text,hashtags,urls,is_retweet,in_reply_to_tweetid,quoted_tweet_tweetid\n"
    good = "abc,2017-03-01 14:05,x,[],[],false,,\n"
    (tmp_path / "a.csv").write_text(head + good + good.rstrip() + ",1,2\n" + "abc,2017-03-01 14:06\n" + good)
    assert A.read_archive(spark, str(tmp_path)).count() == 3
    assert [(r.file.rsplit("/", 1)[1], r.records) for r in A.bad_records(spark, str(tmp_path)).collect()] == [("a.csv", 1)]


def test_numbers_written_as_fractions(spark, tmp_path):
    (tmp_path / "s.csv").write_text("user,ts,action\n1,1488377100.0,1.0\n2,1488377100,2\n3,1488377100.7,x\n4,nan,0\n5,-3.5,0\n")
    got = {r.user: (r.ts, r.action) for r in A.read_sequences(spark, str(tmp_path)).collect()}
    assert got == {"1": (1488377100, 1), "2": (1488377100, 2), "3": (1488377100, None), "5": (-3, 0)}


def test_fingerprints_of_any_size(spark, tmp_path):
    """Empty files, names with blanks, nested folders, and a sparse file of more than 2 GB."""
    import hashlib

    (tmp_path / "in" / "deep").mkdir(parents=True)
    data = {"in/a.bin": b"x" * 5000, "in/b.bin": b"", "in/deep/c d.bin": b"y"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file: (r.bytes, r.sha256) for r in A.fingerprints(spark, str(tmp_path / "in")).collect()}
    assert got == {n.rsplit("/", 1)[1]: (len(d), hashlib.sha256(d).hexdigest()) for n, d in data.items()}
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    sha, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        sha.update(block)
    sha.update(bytes(size & ((1 << 20) - 1)))
    assert [(r.bytes, r.sha256) for r in A.fingerprints(spark, str(tmp_path / "large.bin")).collect()] == [(size, sha.hexdigest())]
    assert A.fingerprints(spark, str(tmp_path / "none")).count() == 0


def test_a_stage_follows_its_inputs(spark, tmp_path):
    source, out = tmp_path / "in.txt", str(tmp_path / "stage")
    source.write_text("1")
    rows = lambda n: spark.range(n)
    assert A.stage(rows(3), out, inputs=str(source)).count() == 3
    assert A.stage(rows(5), out, inputs=str(source)).count() == 3  # unchanged inputs: only read
    source.write_text("2")
    assert A.stage(rows(5), out, inputs=str(source)).count() == 5
    assert A.stage(rows(7), out).count() == 5
