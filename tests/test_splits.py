"""Files read by byte range give the same rows whatever the size of a range."""

import json

import pytest
from pyspark.sql import functions as F

from tallyhand.operators import records, segments
from tallyhand.sources import readers, splits

HAND = "PokerStars Hand #{0}: Tournament #7, $1+$1 USD Hold'em\nSeat 1: ann (100 in chips)\nSeat 2: bob (100 in chips)\n*** HOLE CARDS ***\nDealt to ann [Ah Kd]\nann: folds\n*** SUMMARY ***\nTotal pot {0}"
FILES = {
    "plain.txt": "\n\n".join(HAND.format(i) for i in range(60)),
    "deep/blank_first.txt": "\n \n\n" + "\n\n\n".join(HAND.format(i) for i in range(100, 130)) + "\n\n\n",
    "crlf.txt": "\r\n\r\n".join(HAND.format(i).replace("\n", "\r\n") for i in range(200, 230)),
    "notes.txt": "preamble\n\n" + "\n\n".join(HAND.format(i) + ("\n \nlate note" if i % 3 else "") + ("\n\nTournament Results 1st: x" if i % 5 == 0 else "") for i in range(300, 340)),
    "headless.txt": "\n\n".join(["Seat 1: ann (5)\nDealt to ann", "more text " * 30, "1st: ann", "Seat 3: eve\nDealt to eve\n" + "word " * 200] * 6),
    "no_hands.txt": "nothing here\n\n" * 200,
    "latin.txt": b"\n\n".join(HAND.format(i).encode() + b"\nJos\xe9: says hi" for i in range(400, 420)),
    "mid_header.txt": "\n".join(HAND.format(i) for i in range(500, 510)) + "\n\n   " + HAND.format(511) + "\n\nHand #5 second block\n\nGame Hand #6\nSeat 1: a\nDealt to a",
    "utf8.txt": "\n\n".join(HAND.format(i) + "\nJosé ♠: folds" for i in range(600, 620)),
    "empty.txt": "", "newline.txt": "\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("rooms")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


@pytest.fixture(params=[None, 64, 300, 1000, 7000])
def ranges(request, spark):
    """The size of a range; None is the session's."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    if request.param:
        for k in keys:
            spark.conf.set(k, str(request.param))
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def name_of(path):
    return F.element_at(F.split(path, "/"), -1).alias("name")


def test_hands_do_not_depend_on_ranges(spark, folder, ranges):
    lines = splits.text_lines(spark, folder, "*.txt")
    if ranges == 64:
        assert lines.select("path", "block").distinct().count() > 500
    got = segments.split_pieces(splits.hand_pieces(lines)).select(name_of("path"), "block", "piece", "run", "encoding", "text", "valid").collect()
    whole = readers.text_files(spark, folder).select("name", F.inline(F.array(readers.decode(F.col("content")))))
    want = segments.split_hands(whole.select("name", "text"), "name").collect()
    by_file = lambda rows, order: {n: [(r["text"], r["valid"]) for r in sorted((r for r in rows if r["name"] == n), key=order)] for n in {r["name"] for r in rows}}
    assert by_file(got, lambda r: (r["block"], r["piece"], r["run"])) == by_file(want, lambda r: r["hand_index"])
    assert {r["encoding"] for r in got if r["name"] == "latin.txt"} == {"latin-1"} and all(r["encoding"] == "utf-8" for r in got if r["name"] != "latin.txt")
    assert sum(r["valid"] for r in got) >= 200


def test_lines_are_numbered_and_bad_ones_kept(spark, tmp_path, ranges):
    want, kept = [], []
    for f in range(3):
        out = []
        for i in range(1, 200):
            kind = i % 11
            line = {0: "", 1: "  ", 2: '{"hero": "cut', 3: "no json"}.get(kind, json.dumps({"site": "s", "hero": f"h{i}", "file_id": f"f{f}"}))
            out.append(line)
            if kind in (2, 3):
                want.append((f"{f}.jsonl", i, line))
            elif kind > 3:
                kept.append((f"{f}.jsonl", i, f"h{i}"))
        (tmp_path / f"{f}.jsonl").write_text("\n".join(out) + ("\n" if f else ""))
    bad = splits.bad_lines(spark, str(tmp_path))
    assert sorted((r["name"], r["line_number"], r["bad_line"]) for r in bad.select(name_of("path"), "line_number", "bad_line").collect()) == sorted(want)
    hands = splits.hands_jsonl_lines(spark, str(tmp_path)).where("bad_line IS NULL")
    numbered = splits.with_line_numbers(hands, splits.text_lines(spark, str(tmp_path)))
    assert sorted((r["name"], r["line_number"], r["hero"]) for r in numbered.select(name_of("path"), "line_number", "hero").collect()) == sorted(kept)


def test_the_first_line_wins(spark, tmp_path, ranges):
    rows = [(f, i, f"k{(i * 7 + f) % 40}") for f in range(3) for i in range(150)]
    for f in range(3):
        (tmp_path / f"{f}.jsonl").write_text("\n".join(json.dumps({"hero": k, "tournament_id": f"{f}:{i}"}) for g, i, k in rows if g == f))
    first = {}
    for f, i, k in rows:
        first.setdefault(k, f"{f}:{i}")
    hands = splits.hands_jsonl_lines(spark, str(tmp_path)).select("path", "block", "at", "hero", "tournament_id")
    got = records.first_records(hands, "hero", ["path", "block", "at"]).collect()
    assert {r["hero"]: r["tournament_id"] for r in got} == first


def test_lines_are_shuffled_once(spark, folder):
    """A line moves to its range; the grouping into pieces needs no second exchange of lines."""
    plan = splits.hand_pieces(splits.text_lines(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(path") + plan.count("hashpartitioning(owner") <= 9
