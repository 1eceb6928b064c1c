"""The training-text operators against brute force, and on awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhand.llm import bpe, common, cross_entropy, exact_dedup, fingerprints, html_text, language, near_dup, packing, queries, ranges, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, digest string, keep_id int, bin string, _range int"


def frame(spark, rows):
    """Documents with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, 0, 1, "x", "y", 2, "z", 3) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, long and repeated texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (None, "no id here at all", "en", "a"), (4, long, "de", "a"), (5, long + " end", None, "a"),
        (6, base, "en", "b"), (7, base, "en", "b"), (7, base, "en", "b"), (8, base + " tail", "fr", None), (9, base.replace("w30", "x30"), "en", "a"),
        (10, "one\ttwo\n\nthree", "en", "c"), (11, "one two three", "en", "c"), (12, "!!! 123 ...", "en", "c"), (13, "  ", None, "c"),
        ((1 << 60) + 1, "an id beyond what a float holds", "en", "d"), (14, "Größe\nΣΑΣ é 中文 🙂 <|endoftext|> it's", "de", "c"), (15, "line\n" * 50, "en", "a"), (None, None, None, None),
    ]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return common.table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def text_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def registered(spark, monkeypatch, name, **tables):
    """A registered query's rows over tables given here."""
    monkeypatch.setattr(queries, "table", lambda _, __, n: tables[n])
    return rows_of(queries.QUERIES[name](spark, ""))


# fingerprints


def parts(text):
    return {x.strip() for x in re.findall(r"(?:\S+[^\S\n]*){1,8}", text)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_fingerprints(request, name):
    docs = request.getfixturevalue(name)
    got = rows_of(fingerprints.fingerprints(docs))
    texts = text_of(docs)
    assert len(got) == len(texts)
    if name == "documents":
        order = sorted(texts, key=lambda r: -r[0])
        want = {}
        for at, (i, text) in enumerate(order):
            following = order[(at + 1) % len(order)][1]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + following[:cut]
            want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(parts(text), parts(edited)), likeness(parts(text), parts(following)))
        for r in got:
            n, sha, edited, following = want[r["doc_id"]]
            assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
            assert r["near_edited"] == pytest.approx(edited) and r["near_next"] == pytest.approx(following)
    same = defaultdict(set)
    for r, (_, text) in zip(sorted(got, key=lambda r: (r["doc_id"] or -1, r["n_chars"])), sorted(texts, key=lambda t: (t[0] or -1, len(t[1])))):
        same[text].add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_next_text_crosses_ranges(spark, monkeypatch):
    rows = [(i, f"text {i} " * 3, None, None) for i in range(300)]
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 400)
    order = {r["doc_id"]: r["edited_sha256"] for r in rows_of(fingerprints.fingerprints(frame(spark, rows)))}
    for i, text, _, _ in rows:
        following = rows[i - 1][1]
        cut = len(text) // 3
        assert order[i] == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()


def test_peeling_retries_when_a_sketch_is_too_small(spark):
    a = list(range(1, 3000, 7))
    b = list(range(1, 3000, 5))
    sets = spark.createDataFrame([(a, b), (a, a), ([], b[:3])], "a array<long>, b array<long>")
    hashed = sets.select(F.transform("a", lambda x: F.xxhash64(x)).alias("a_digests"), F.transform("b", lambda x: F.xxhash64(x)).alias("b_digests"))
    sketched = hashed.withColumns({"a_sketch": F.expr(fingerprints.sketch("a_digests")), "b_sketch": F.expr(fingerprints.sketch("b_digests"))})
    got = rows_of(fingerprints.with_difference(sketched, "a", "b", "d"))
    for row in got:
        left, right = set(row["a_digests"]), set(row["b_digests"])
        assert {x["k"] for x in row["d"] if x["n"] == 1} == left - right
        assert {x["k"] for x in row["d"] if x["n"] == -1} == right - left


def folded_shingles(text, n=5):
    """Runs of 5 words, or of 5 characters where there are no blanks; no paragraph is cut."""
    words = re.findall(r"\w+", text.lower())
    words = words if len(words) > 3 else list("".join(words))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def test_registered_likeness_follows_the_text(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(900)]
    line = " ".join(rng.choice(words, 3000))
    chinese = "".join(chr(c) for c in rng.integers(0x4E00, 0x5E00, 4000))
    token = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 4000))
    pairs = [
        (line, "early " + line), (line, line.split(" ", 3)[3]), (line, line.upper().replace(" ", ", ")), (line, " ".join(rng.choice(words, 3000))),
        (chinese, "新" + chinese), (chinese, chinese[:2000] + chinese[2003:]), (token, "x" + token), (token, token[:9] + token[11:]),
    ]
    # the next document is the one before by doc_id
    rows = [(2 * k + j, text, None, None) for k, pair in enumerate(pairs) for j, text in enumerate(pair)]
    got = {r["doc_id"]: r for r in registered(spark, monkeypatch, "op1_fingerprints", documents=frame(spark, rows))}
    texts = {i: t for i, t, _, _ in rows}
    for k, (a, b) in enumerate(pairs):
        assert got[2 * k + 1]["near_next"] == pytest.approx(likeness(folded_shingles(a), folded_shingles(b)), abs=0.06), k
    for i, text in texts.items():
        if i in (0, 8, 12):
            continue  # gets a third of another script, whose words weigh differently in the comparison
        cut = len(text) // 3
        edited = text[: len(text) - cut] + texts[(i - 1) % len(texts)][:cut]
        assert got[i]["near_edited"] == pytest.approx(likeness(folded_shingles(text), folded_shingles(edited)), abs=0.12), i
    assert got[5]["fingerprint"] == got[4]["fingerprint"]


def test_registered_likeness_on_the_documents(spark, monkeypatch, documents):
    got = {r["doc_id"]: r for r in registered(spark, monkeypatch, "op1_fingerprints", documents=documents)}
    order = sorted(text_of(documents), key=lambda r: -r[0])
    off = []
    for at, (i, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        cut = len(text) // 3
        want = likeness(folded_shingles(text), folded_shingles(text[: len(text) - cut] + following[:cut]))
        if len(text.split()) >= 200:
            off.append(abs(got[i]["near_edited"] - want))
            assert got[i]["near_next"] == pytest.approx(likeness(folded_shingles(text), folded_shingles(following)), abs=0.25), i
    assert off and np.mean(off) < 0.1


def test_text_without_words_has_a_digest(spark, monkeypatch):
    got = {r["doc_id"]: r for r in registered(spark, monkeypatch, "op1_fingerprints", documents=frame(spark, [(1, "...", None, None), (2, "---", None, None), (3, "", None, None), (4, " ", None, None)]))}
    assert got[2]["near_next"] == 0 and got[4]["near_next"] == 1 and len({got[i]["fingerprint"] for i in (1, 2, 3)}) == 3


# near duplicates


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    sets = [shingles(t) for _, t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (a or b) and len(a & b) >= 0.8 * len(a | b) or not (a or b) and texts[i][1] == texts[j][1]:
            links[i] += 1
            links[j] += 1
            parent[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(texts)):
        members[find(i)].append(i)
    named = {g: min((texts[i][0] for i in m if texts[i][0] is not None), default=None) for g, m in members.items()}
    return Counter((texts[i][0], named[find(i)], links[i]) for i in range(len(texts)))


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_near_groups(request, name):
    docs = request.getfixturevalue(name)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(near_dup.near_groups(docs)))
    assert got == brute_groups(text_of(docs))


def test_near_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_TEXTS", 8)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]]), None, None) for k in range(40)] + [(100, "another text of its own entirely", None, None)]
    docs = frame(spark, rows)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(near_dup.near_groups(docs))) == brute_groups(text_of(docs))
    assert sorted(r["doc_id"] for r in rows_of(near_dup.without_near_copies(docs))) == [0, 100]


def test_pages_of_one_template_are_not_all_compared(spark, monkeypatch):
    """Pages that share 45 % of their n-grams chain by chance; pairs without a common band are left alone."""
    template = [f"t{i}" for i in range(124)]
    rows = [(k, " ".join([*template, *(f"p{k}x{i}" for i in range(76))]), None, None) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + f" tail{k}", None, None) for k in range(0, 300, 10)]
    docs = frame(spark, rows)
    seen = {}
    plain = common.written

    def kept(df, name):
        seen[name] = plain(df, name)
        return seen[name]

    monkeypatch.setattr(near_dup, "written", kept)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(near_dup.near_groups(docs)))
    assert got == brute_groups(text_of(docs)) and sum(n for *_, n in got) == 60
    bands, _ = near_dup.bands_and_rows()
    groups = Counter(f for r in seen["members"].select("firsts").collect() for f in set(r["firsts"]) - {-1})
    assert sum(groups.values()) <= bands * len(rows)
    assert sum(n * n for n in groups.values()) < 0.25 * len(rows) ** 2 and max(groups.values()) < len(rows) / 2


def test_hubs_of_components_are_salted(spark):
    edges = spark.range(3000).selectExpr("id + 5 as a", "0L as b").union(spark.sql("select 9000L a, 9001L b"))
    found = {r["node"]: r["root"] for r in near_dup.components(edges).collect()}
    assert len(found) == 3003 and {v for k, v in found.items() if k < 9000} == {0} and found[9001] == found[9000] == 9000


def test_bands_reach_the_recall():
    bands, rows = near_dup.bands_and_rows(0.8, 0.9999, 300)
    assert bands * rows <= 300 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows_of(near_dup.components(edges))}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# sharding


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_shards(request, name):
    import zlib

    docs = request.getfixturevalue(name)
    got = rows_of(sharding.shard_by_bytes(docs))
    texts = text_of(docs)
    want = Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, held = defaultdict(list), Counter()
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if name == "documents":
        mean = sum(held.values()) / 40
        largest = max(r["size"] for r in got)
        assert len(held) == 40 and max(held.values()) <= max(1.05 * mean, largest) and min(held.values()) >= 0.9 * mean - max(0, largest - mean)


def test_each_range_has_a_partition(spark):
    for n in (1, 2, 7, 64, 200):
        numbers = ranges.own_partitions(spark, n)
        rows = spark.createDataFrame([(x,) for x in numbers], "p long").repartition(n, "p").select(F.spark_partition_id().alias("at")).collect()
        assert sorted(r["at"] for r in rows) == list(range(n))


def test_ranges_subdivide_a_hot_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id"), F.lit(10).cast("long").alias("w"))
    keyed = common.written(rows.select(ranges.sortable(F.col("k"), F.col("id")).alias("key"), "w"), "test")
    bounds, sizes = ranges.split_ranges(keyed, "key", "w", 1500.0)
    assert sum(n for n, _ in sizes) == 6000 and max(w for _, w in sizes) <= 3010 and len(bounds) >= 20
    low = keyed.select(ranges.range_of(F.col("key"), bounds).alias("r"), "key").collect()
    assert all(r["r"] == ranges.find(bounds, r["key"]) for r in low)


# scoring


def counted(texts, good):
    """The counts a task gives for texts in one process, as train() puts them together."""
    import pandas as pd

    found = np.zeros((2, cross_entropy.SLOTS), np.float32)
    for part in cross_entropy._count(iter([pd.DataFrame({"text": list(texts.values()), "target": [i in good for i in texts]})])):
        found[0, part["slot"]], found[1, part["slot"]] = part["target"], part["background"]
    return found


def brute_losses(texts, good):
    def counts(ids):
        found = Counter()
        for i in ids:
            padded = "\0\0\0" + texts[i].lower()
            for k in range(2, len(padded)):
                for n in range(1, 5 if k > 2 else 4):
                    found[padded[k - n + 1 : k + 1]] += 1
        return found

    models = [counts(good), counts(texts)]
    for i, text in texts.items():
        padded = "\0\0\0" + text.lower()
        sums = []
        for m in models:
            total, loss = max(1, sum(m.values()) / 4), 0.0
            for k in range(3, len(padded)):
                share = 1 / 4096
                for n in range(1, 5):
                    share = (m[padded[k - n + 1 : k + 1]] + 8 * share) / ((m[padded[k - n + 1 : k]] if n > 1 else total) + 8)
                loss -= np.log(share)
            sums.append(loss)
        yield i, len(padded) - 3, sums


def test_losses_of_exact_counts(documents, monkeypatch):
    texts = dict(text_of(documents.where("doc_id < 40")))
    good = {i for i in texts if i % 3}
    monkeypatch.setattr(cross_entropy, "SLOTS", 1 << 26)  # hardly an n-gram shares a slot
    n, sums = cross_entropy.losses([t.lower() for t in texts.values()], counted(texts, good))
    for (_, tokens, want), got_n, got in zip(brute_losses(texts, good), n, sums):
        assert tokens == got_n and got == pytest.approx(want, rel=2e-3)


def test_cross_entropy(spark, sf_dir, documents):
    labels = common.table(spark, sf_dir, "labels")
    got = {r["doc_id"]: r for r in rows_of(cross_entropy.cross_entropy_difference(documents, labels))}
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()}
    texts = dict(text_of(documents))
    n, sums = cross_entropy.losses([t.lower() for t in texts.values()], counted(texts, good & set(texts)))
    for i, tokens, (target, background) in zip(texts, n, sums):
        assert got[i]["n_tokens"] == tokens and got[i]["score"] == pytest.approx((target - background) / tokens, abs=1e-4)
        assert got[i]["target_loss"] == pytest.approx(target / tokens, rel=1e-4)


def test_cross_entropy_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(6, 1, None), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(cross_entropy.cross_entropy_difference(awkward, labels))
    assert len(got) == awkward.count()
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    base = {r["doc_id"]: r["score"] for r in got}
    assert base[6] < base[4]
    assert rows_of(cross_entropy.cross_entropy_difference(empty, labels)) == []


def test_long_texts_score_the_same_in_pieces(monkeypatch):
    texts = ["abc def " * 300, "", "xyz", "q" * 1000]
    counts = np.random.default_rng(1).integers(1, 9, (2, cross_entropy.SLOTS)).astype(np.float32)
    whole = cross_entropy.losses(texts, counts)
    monkeypatch.setattr(cross_entropy, "_TOKENS", 64)
    cut = cross_entropy.losses(texts, counts)
    assert (whole[0] == cut[0]).all() and np.allclose(whole[1], cut[1], rtol=1e-4)


def test_registered_scores_share_no_counts(spark, monkeypatch, documents, sf_dir):
    # the slots must not matter to the query: with 8 of them, hashed counts say nothing
    labels = common.table(spark, sf_dir, "labels")
    monkeypatch.setattr(cross_entropy, "SLOTS", 8)
    monkeypatch.setattr(cross_entropy, "BLOCK_CHARS", 20_000)
    got = {r["doc_id"]: r for r in registered(spark, monkeypatch, "op4_lm_scoring", documents=documents, labels=labels)}
    texts = dict(text_of(documents))
    good = {r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect()} & set(texts)
    assert len(got) == len(texts)
    for i, (_, tokens, want) in zip(texts, brute_losses(texts, good)):
        assert got[i]["n_tokens"] == tokens
        if tokens:
            assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx(tuple(np.array(want) / tokens), rel=1e-9)


def test_registered_scores_of_awkward_rows(spark, monkeypatch, awkward, empty):
    labels = spark.createDataFrame([(6, 1, None), (6, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = registered(spark, monkeypatch, "op4_lm_scoring", documents=awkward, labels=labels)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in awkward.collect())
    assert all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert registered(spark, monkeypatch, "op4_lm_scoring", documents=empty, labels=labels) == []


def test_exact_counts_of_any_alphabet_in_pieces(monkeypatch):
    texts = {i: "".join(chr(0x4E00 + (i * 7919 + k * k * 31) % 20000) for k in range(900)) + "abc " * 40 for i in range(6)} | {9: ""}
    monkeypatch.setattr(cross_entropy, "BLOCK_CHARS", 100)
    monkeypatch.setattr(cross_entropy, "_TABLE", 0)
    counts = pd.concat(cross_entropy._block_counts(0, list(texts.values()), [i in {1, 9} for i in texts]))
    model = counts.groupby(["high", "low"], as_index=False)[["target", "background"]].sum()
    n, sums = cross_entropy.exact_losses(list(texts.values()), model, tuple(max(1, model[c].sum()) / 4 for c in ("target", "background")))
    for (_, tokens, want), got_n, got in zip(brute_losses(texts, {1, 9}), n, sums):
        assert tokens == got_n and got == pytest.approx(want, rel=1e-9)


# packing


@pytest.mark.parametrize("name", ["documents", "awkward"])
@pytest.mark.parametrize("group", [8192, 30])
def test_packing(request, monkeypatch, name, group):
    monkeypatch.setattr(packing, "GROUP", group)
    docs = request.getfixturevalue(name)
    got = rows_of(packing.pack(docs, 512))
    texts = text_of(docs)
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in texts)
    assert sum(r["size"] for r in got) == sum(len(re.findall(r"[^\t\n\x0b\f\r ]+", t)) for _, t in texts)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r)
    for held in bins.values():
        assert sum(r["size"] for r in held) <= 512
        named = [r["source"] for r in held if r["source"] is not None]
        assert len(set(named)) == len(named) and len({r["cluster"] for r in held}) == len(held)
        spans = sorted((r["bin_offset"], r["size"]) for r in held)
        assert all(a + n <= b or n == 0 or m == 0 for (a, n), (b, m) in zip(spans, spans[1:]))


def test_rounds_bring_half_filled_bins_together(spark, monkeypatch):
    """Many small groups end with about as many bins as one group does."""
    draw = np.random.default_rng(8)
    docs = frame(spark, [(i, f"w{i} " * int(draw.integers(1, 400)), None, f"s{draw.integers(0, 40)}") for i in range(600)])
    bins = lambda: len({r["bin"] for r in rows_of(packing.pack(docs, 512))})
    whole = bins()
    monkeypatch.setattr(packing, "GROUP", 40)
    assert bins() <= 1.05 * whole
    monkeypatch.setattr(packing, "SHRINK", 0.0)  # one round only
    assert bins() > 1.05 * whole


def test_clusters_may_be_named(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i}", i % 2) for i in range(10)], "doc_id long, text string, source string, class_id long")
    held = defaultdict(list)
    for r in rows_of(packing.pack(docs, 100, cluster="class_id")):
        held[r["bin"]].append(r["doc_id"] % 2)
    assert sorted(map(sorted, held.values())) == [[0, 1]] * 5


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    bins, plain = packing.Bins(100), []
    for size, source in zip(rng.integers(1, 100, 3000).tolist(), rng.integers(0, 6, 3000).tolist()):
        got = bins.place(size, 1 << source)
        open_bins = sorted((room, k) for k, (room, mask) in enumerate(plain) if room >= size and not mask >> source & 1)
        if open_bins:
            room, k = open_bins[0]
        else:
            room, k = 100, len(plain)
            plain.append((100, 0))
        assert got == (k, 100 - room)
        plain[k] = (room - size, plain[k][1] | 1 << source)


# language


def test_language_held_out_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    got = rows_of(language.languages(documents))
    out = [r for r in got if r["held_out"]]
    assert len(out) > 20 and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_rows(awkward, empty, spark):
    got = Counter((r["doc_id"], r["lang_pred"] == "und") for r in rows_of(language.languages(awkward)))
    assert got == Counter((i, not any(map(str.isalpha, t))) for i, t in text_of(awkward))
    assert rows_of(language.languages(empty)) == []
    unlabelled = frame(spark, [(1, "some text", None, None)])
    assert [(r["lang_pred"], r["score"]) for r in rows_of(language.languages(unlabelled))] == [("und", 0.0)]
    kept = language.with_known_language(awkward)
    assert kept.columns == awkward.columns


def slots_of(text):
    """The n-grams of a text as the operator hashes them, one by one."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    found = []
    for order in language.ORDERS:
        for i in range(len(letters) - order + 1):
            mixed = order
            for c in letters[i : i + order]:
                mixed = (mixed ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                mixed ^= mixed >> 15
            found.append(mixed % language.SLOTS)
    return found


@pytest.mark.parametrize("matrix_bytes", [language.MATRIX_BYTES, 0])
@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_language_is_naive_bayes(request, monkeypatch, name, matrix_bytes):
    """Every prediction and score against counts, sums and logarithms in plain Python, with the model broadcast and joined."""
    import math
    import zlib

    plain = language.train
    monkeypatch.setattr(language, "train", lambda docs: plain(docs, matrix_bytes))
    docs = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i, _, _ in rows}
    counted, priors = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if lang is not None and not out[i]:
            counted[lang].update(slots_of(text))
            priors[lang] += 1
    total = {lang: sum(c.values()) + language.SMOOTHING * language.SLOTS for lang, c in counted.items()}
    got = defaultdict(list)
    for r in rows_of(language.languages(docs)):
        got[r["doc_id"]].append((r["held_out"], r["lang_pred"], r["score"]))
    want = defaultdict(list)
    for i, text, _ in rows:
        if not any(map(str.isalpha, text)):
            want[i].append((out[i], "und", 0.0))
            continue
        slots = Counter(slots_of(text))
        sums = {lang: math.log(priors[lang] / sum(priors.values())) + sum(n * math.log((c[s] + language.SMOOTHING) / total[lang]) for s, n in slots.items()) for lang, c in counted.items()}
        best = max(sums, key=sums.get)
        want[i].append((out[i], best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())))
    assert set(got) == set(want)
    for i, rows_got in got.items():
        for (a, lang, score), (b, lang_want, score_want) in zip(sorted(rows_got), sorted(want[i])):
            assert (a, lang) == (b, lang_want) and score == pytest.approx(score_want, abs=2e-3)


def test_language_names_stay_as_they_are(spark):
    rows = [(i, "abc abd " * 5 if i % 2 else "xyz xyy " * 5, "one\x00" if i % 2 else "one", None) for i in range(40)]
    got = rows_of(language.languages(frame(spark, rows)))
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in got} == {(1, "one\x00"), (0, "one")}


def test_texts_unlike_their_language_go(spark, documents):
    """Long texts that no learned language reads like are rejected, clean documents and short ones stay."""
    draw = np.random.default_rng(5)
    odd = ["".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 2000)), "щука и рак в реке " * 60, "東京都千代田区" * 120]
    more = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(odd)], documents.schema)
    kept = {r["doc_id"] for r in language.with_known_language(documents.unionByName(more)).collect()}
    lettered = {r["doc_id"] for r in documents.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert not kept & {10**9 + i for i in range(len(odd))}
    assert len(lettered - kept) <= 0.01 * len(lettered)


def test_long_texts_count_the_same_in_pieces(monkeypatch):
    texts = ["Ein langer Text " * 400, "", "a", "kurz"]
    table = np.random.default_rng(2).normal(size=(language.SLOTS + 1, 3)).astype(np.float32)
    whole = language.posterior(texts, table)
    monkeypatch.setattr(language, "_CHARS", 50)
    cut = language.posterior(texts, table)
    assert np.allclose(whole[0], cut[0], atol=1e-3) and (whole[1] == cut[1]).all() and (whole[2] == cut[2]).all()


# byte pairs


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    made = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path(bpe.VOCABULARY))
    made.no_truncation()
    made.no_padding()
    return made


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_bpe_digests(request, name, library):
    docs = request.getfixturevalue(name)

    def want(i, text):
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    got = Counter(tuple(r.values()) for r in rows_of(bpe.digests(docs)))
    assert got == Counter(want(i, t) for i, t in text_of(docs))


def test_bpe_on_any_text(library):
    import random

    random.seed(7)
    made = bpe.tokenizer(bpe.VOCABULARY)
    letters = "abcdefghijklmnopqrstuvwxyzABΣİßé ’'\n\x1c\x85,.!%$012<|>中🙂🏽́ﬁ²\u0000​"
    for k in range(3000):
        text = "".join(random.choice(letters if k % 3 else "aehrtinos") for _ in range(random.randrange(30)))
        text += "<|endoftext|>" * (k % 40 == 0)
        assert made.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_on_every_code_point(library):
    """Inside a word, where letters, numbers, marks, blanks and others part ways, and after a letter that composes."""
    made = bpe.tokenizer(bpe.VOCABULARY)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b" for c in points[i : i + 512]) for i in range(0, len(points), 512)]
    texts += [" ".join(f"E{c}. {c}{c}" for c in points[i : i + 512]) for i in range(0, 0x20000, 512)]
    odd = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if made.encode(t) != e.ids]
    assert not odd


def test_bpe_ids(awkward):
    made = bpe.tokenizer(bpe.VOCABULARY)
    for r in rows_of(bpe.encoded(awkward.where("doc_id in (1, 10, 14)"))):
        assert bool(r["ids"]) == (r["doc_id"] != 1) and made.decode(r["ids"]).count(" ") == max(0, len(r["ids"]) - 1)


# revisits


def test_revisits(spark):
    from datetime import datetime

    at = lambda n: datetime(2024, 1, 1, 0, n)
    tag = {"etag": '"a"', "content-type": "text/html", "content-length": "5", "cache-control": "old"}
    rows = [
        (1, "http://www.x.org/p/?b=2&a=1#f", at(1), "response", 200, tag),
        (2, "https://x.org/p?a=1&b=2&utm_source=z", at(2), "revisit", 304, {"etag": 'W/"a"', "content-length": "0", "cache-control": "new", "x": "y"}),
        (3, "https://x.org/p?a=1&b=2", at(3), "response", 404, {}),
        (4, "https://x.org/p?a=1&b=2", at(4), "revisit", 304, {"etag": '"b"'}),
        (5, "https://x.org/p?a=1&b=2", at(5), "revisit", 304, None),
        (6, "https://x.org/p?a=1&b=2", at(1), "revisit", 304, tag),
        (7, None, at(9), "revisit", 304, tag),
        (8, "https://x.org/p?a=1&b=2", None, "revisit", 304, tag),
        (9, "https://x.org/q", at(0), "response", 200, {"last-modified": "m"}),
        (10, "https://x.org/q", at(7), "revisit", 304, {"last-modified": "m"}),
        (10, "https://x.org/q", at(7), "revisit", 304, {"last-modified": "m"}),
        (None, "https://x.org/none", at(7), "revisit", 304, {}),
    ]
    schema = "record_id long, url string, date timestamp, kind string, status int, headers map<string,string>, _full int, outcome string"
    got = rows_of(warc.resolve_revisits(spark.createDataFrame([(*r, 1, "clash") for r in rows], schema)))
    found = Counter((r["record_id"], r["outcome"], r["refers_to"]) for r in got)
    assert found == Counter(
        [(2, "resolved", 1), (4, "validators differ", None), (5, "no validators", None), (6, "no earlier response", None), (7, "no url or date", None),
         (8, "no url or date", None), (10, "resolved", 9), (10, "resolved", 9), (None, "no earlier response", None)]
    )
    merged = next(r["headers"] for r in got if r["record_id"] == 2)
    assert merged == {"etag": 'W/"a"', "content-type": "text/html", "content-length": "5", "cache-control": "new"}
    assert rows_of(warc.resolve_revisits(spark.createDataFrame([], schema))) == []


def test_a_hot_url_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    kind = F.when(F.col("id") % 50 == 0, "response").otherwise("revisit")
    records = spark.range(1000).select(
        F.col("id").alias("record_id"), F.lit("http://hot.org/").alias("url"), F.timestamp_seconds(F.col("id") * 10).alias("date"), kind.alias("kind"),
        F.when(kind == "response", 200).otherwise(304).alias("status"), F.create_map(F.lit("etag"), F.lit("e")).alias("headers"),
    )
    got = rows_of(warc.resolve_revisits(records))
    assert len(got) == 980 and all(r["refers_to"] == r["record_id"] // 50 * 50 for r in got)


# exact copies


@pytest.mark.parametrize("name", ["documents", "awkward"])
@pytest.mark.parametrize("most", [1, 48 << 20])
def test_exact_groups(request, name, most):
    docs = request.getfixturevalue(name)
    texts = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in text_of(docs)]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    want, kept = Counter(), Counter()
    for i, t in texts:
        keep = min((x for x in groups[t] if x is not None), default=None)
        want[i, keep, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = rows_of(exact_dedup.exact_groups(docs, most))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    stay = exact_dedup.without_copies(docs, most)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_trie_holds_whole_strings():
    trie = exact_dedup.Trie()
    bodies = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 500, b"b" * 499 + b"c", b"a"]
    for i, body in enumerate(bodies):
        trie.add(body, str(len(body)), 10 - i, 1)
    assert Counter({b: n for b, _, _, n in exact_dedup.terminals(trie.root)}) == Counter(bodies)
    assert {b: k for b, _, k, _ in exact_dedup.terminals(trie.root)}[b"a"] == 3
    spilt = [b for b, _, _, _ in trie.spill()]
    assert set(spilt) == {b"b" * 500, b"b" * 499 + b"c"} and b"abc" in {b for b, *_ in exact_dedup.terminals(trie.root)}


def test_one_trie_holds_all_texts_of_a_key(spark):
    import pyarrow as pa

    # three keys: two of length 2, and one of length 3; texts of one key have digests that begin alike
    rows = [(2, "abc1", b"xy", 7, 2), (2, "abc2", b"xz", 9, 1), (2, "abc1", b"xy", 3, 1), (2, "abd1", b"xy", 1, 1), (3, "abc1", b"xyz", None, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcde"))
    for most, held in ((1 << 20, [(2, "abc1", 3, 3), (2, "abc2", 9, 1), (2, "abd1", 1, 1), (3, "abc1", None, 1)]), (1, None)):
        found = [r for b in exact_dedup._owners(iter([batch]), most) for r in zip(*(c.to_pylist() for c in b.columns))]
        if held:
            assert sorted((n, d, k, c) for n, d, _, k, c in found) == held
        settled = exact_dedup._settled(spark.createDataFrame(found, exact_dedup._OWNER))
        assert sorted(tuple(r) for r in settled.collect()) == [(2, "abc1", 3, 3), (2, "abc2", 9, 1), (2, "abd1", 1, 1), (3, "abc1", None, 1)]


def test_different_texts_with_one_digest_fail(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array(["d", "d"]), pa.array([b"a", b"b"]), pa.array([1, 2]), pa.array([1, 1])], names=list("abcde"))
    found = [r for b in exact_dedup._owners(iter([batch]), 1 << 20) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert len(found) == 2  # bodies tell them apart
    with pytest.raises(Exception, match="share the digest"):
        exact_dedup._settled(spark.createDataFrame(found, exact_dedup._OWNER)).collect()


# pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><div class="cookie-notice"><p>We use cookies here.</p></div>
<article><h1>The &amp; title</h1><p><b>First  paragraph&nbsp;is here<br>and goes on.<p>Second one.<div class="comments"><p>Long comment by some reader who has much to say about it all.</p></div>
<form><input><label>Name</label></form></article><aside><p>More stories that you may like to read.</p></aside><footer>&copy; 2024</footer>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>" + "long text of words " * 20000), (5, "u", "<<<>>> <p class='x"), (1, "u", PAGE)]
    got = rows_of(html_text.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")))
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = defaultdict(list)
    for r in got:
        texts[r["page_id"]].append(r["text"])
    assert texts[1] == ["The & title\n\nFirst paragraph is here and goes on.\n\nSecond one."] * 2
    assert texts[2] == [""] and texts[3] == [""] and texts[None][0].count("long text") == 20000


@pytest.mark.parametrize("put, kept", [
    ('<svg width="1"/>', ""), ("<svg/>", ""), ("<SVG />", ""), ("<math/>", ""), ("<svg>", ""), ("<canvas>", ""), ("<object data=a>", ""), ("<template>", ""), ("<noscript>", ""),
    ("<svg-icon name=x></svg-icon>", ""), ("<math-renderer>kept</math-renderer>", "kept"), ("<title-bar>kept</title-bar>", "kept"), ("<script-x>kept</script-x>", "kept"),
    ("<math><mi>E</mi><mo>=</mo><mi>mc</mi></math>", "E=mc"), ("<svg><svg><text>gone</text></svg><text>gone</text></svg>", ""), ("<svg><title/><style/><text>gone</text></svg>", ""),
    ("<svg><text>gone</text></svg>", ""), ("<svg/><svg><text>gone</text></svg>", ""), ("<script src=a />gone</script>", ""), ("<style>gone</style>", ""), ("<!-- <svg> -->", ""),
    ("<object><p>gone</p></object>", ""), ('<script>"<svg>"</script>', ""),
])
def test_elements_end_where_they_end(put, kept):
    tree = html_text.grow(np.array(html_text.LABELLED, float))
    first, last = "The article begins with a sentence of some length, as articles do, and it goes on for a while. ", "It ends with another sentence of much the same length, so that both are taken for its text."
    page = f"<html><body><article><p>{first}{put}</p><p>{last}</p></article></body></html>"
    assert html_text.main_text(page, tree) == f"{first}{kept}".strip() + "\n\n" + last


def test_unclosed_elements_cost_no_square():
    tree = html_text.grow(np.array(html_text.LABELLED, float))
    assert html_text.main_text("<article><p>" + "<svg><object>" * 50_000 + "the end of a long page" + "<title/>" * 50_000, tree) == "the end of a long page"


@pytest.mark.parametrize("page", [
    "<script " * 200_000, "<svg " * 200_000, "<div class='" * 100_000, "<a " * 200_000, "<!-- " * 200_000, "<title/>" * 100_000, "<script>" * 100_000, "</div " * 100_000,
    "<a x='>' " * 100_000 + "'", "<a x=\">\" " * 100_000 + "y=\"", "<div class='" * 100_000 + ">", "<a '" * 100_000 + "> x", "<script/>" * 100_000 + "</style>", "<" * 500_000 + ">",
    "<div>" * 100_000 + "</p>" * 100_000, "<form>" * 60_000 + "some words", "<nav>" * 60_000 + "</section>" * 60_000, "<p class=comment>" * 60_000, "<svg>" * 100_000 + "</svg>" * 100_000,
    "<a href=" + "=" * 500_000, "<a " + "a=' " * 200_000 + ">", "&amp" * 200_000,
], ids=range(22))
def test_broken_pages_take_linear_time(page):
    import time

    tree = html_text.grow(np.array(html_text.LABELLED, float))
    began = time.process_time()
    html_text.main_text(page, tree)
    assert time.process_time() - began < 5


ARTICLE = "<h1>A title here</h1>" + "<p>This is a paragraph of the article, with enough words to look like running text and no links at all.</p>" * 4
AROUND = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"
CARD = "<p>A card that tells of another article in a few words.</p>"


@pytest.mark.parametrize("page", [
    f"<form id=aspnetForm>{AROUND}<div id=content>{ARTICLE}</div></form>", f"<form id=aspnetForm>{AROUND}<div>{ARTICLE}</div></form>", f'<article class="widget">{ARTICLE}</article>',
    f'<div class="layout sidebar-left-page">{AROUND}<div>{ARTICLE}</div></div>', f'{AROUND}<main class="site-main widget-area">{ARTICLE}</main>', f'<section class="entry-content share">{ARTICLE}</section>',
    f"<div id=share-tags-article><article>{ARTICLE}</article></div>", f"<div class=comments-open><div>{ARTICLE}</div></div>", f"<div style='display: none'>{ARTICLE}</div>",
    f'<form>{AROUND}<div class="social widget">{ARTICLE}</div><aside>{CARD}</aside></form>', f'<main>{ARTICLE}</main><section class="comments">{"<article class=comment>" + CARD + "</article>"}</section>',
    f'<main>{ARTICLE}</main><div id="comments">{("<article class=comment>" + CARD + "</article>") * 20}</div>', f"<div class=header-wrapper><header>{AROUND}</header><div>{ARTICLE}</div></div>",
    f"<main>{ARTICLE}</main><aside><article class=teaser>{CARD}</article></aside>", f'<div class="page-wrap with-banner promo"><article>{ARTICLE}</article><div class="promo">{CARD}</div></div>',
    f"<div title=it's><article>{ARTICLE}</article></div><footer>{CARD}</footer>", f"<a title=it's href=x>Skip</a><article>{ARTICLE}</article><a title=it's>More</a>",
    f"<dialog open><main>{ARTICLE}</main></dialog>", f"<div class='notice'>{CARD * 3}</div><div>{ARTICLE}</div>", f"<div class='cookie'>{CARD}</div><div class='share'><div class='post'>{ARTICLE}</div></div>",
], ids=range(20))
def test_no_wrapper_empties_a_page(page):
    tree = html_text.grow(np.array(html_text.LABELLED, float))
    want = re.sub(r"\n+", "\n\n", re.sub(r"<[^>]*>", "\n", ARTICLE)).strip()
    assert html_text.main_text(f"<html><body>{page}</body></html>", tree) == want


def test_pages_give_their_article(spark, sf_dir):
    import html

    pages = common.table(spark, sf_dir, "pages")
    got = {r["page_id"]: r["text"] for r in rows_of(html_text.extract(pages))}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|h2|p|li|ul)[^>]*>", article)]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)


def test_tree_learns_its_table():
    rows = np.array(html_text.LABELLED, float)
    tree = html_text.grow(rows)
    assert all(html_text.decide(tree, tuple(r[:-1])) == bool(r[-1]) for r in rows)


# empty tables


@pytest.mark.parametrize("operator", [fingerprints.fingerprints, near_dup.near_groups, sharding.shard_by_bytes, packing.pack, bpe.digests, exact_dedup.exact_groups,
                                      near_dup.without_near_copies, exact_dedup.without_copies, language.with_known_language])
def test_empty_tables(operator, empty):
    assert operator(empty).collect() == []
