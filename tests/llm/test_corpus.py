"""Operators over the whole corpus, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import chat_format, mixing, near_dedup, sharding, warc
from faultline.llm.components import components
from faultline.llm.near_dedup import NearDup, agreement, near_groups
from faultline.llm.registry import QUERIES
from faultline.llm.substring_dedup import Repeats, remove_repeats
from faultline.llm.suffix_array import suffix_array
from faultline.session import stage, work_dir


def check_near(df, rows, n):
    wanted = brute.near(rows, n)
    found = {r.doc_id: r for r in df.collect()}
    assert len(found) == len(rows)
    for d, (size, low) in wanted.items():
        assert (found[d].n_shingles, found[d].component_id, found[d].kept) == (size, low, d == low)


def test_near_groups_on_odd_texts(odd_docs, odd_texts, empty_docs):
    check_near(near_groups(odd_docs, NearDup(shingle_words=2)), list(enumerate(odd_texts)), 2)
    check_near(near_groups(odd_docs, NearDup()), list(enumerate(odd_texts)), 5)
    assert near_groups(empty_docs).count() == 0


def test_near_groups_on_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_near(QUERIES["op1_near_dedup"](spark, sf), rows, 2)


def test_exploded_rows_are_not_broadcast(odd_docs, odd_texts, monkeypatch):
    """Spark sizes exploded rows too low, so the planner may not choose by that size."""
    plans = {}

    def noted(df, purpose):
        plans.setdefault(purpose, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, purpose)

    monkeypatch.setattr(near_dedup, "stage", noted)
    check_near(near_groups(odd_docs, NearDup()), list(enumerate(odd_texts)), 5)
    assert plans["members"] and not any("BroadcastExchange" in p for p in plans["members"])


def test_hot_group_is_whole_across_blocks(spark):
    """Copies of one text that differ from it by up to a fifth: many members are linked to others only."""
    rng, base, rows = random.Random(2), [f"w{k}" for k in range(120)], []
    for d in range(160):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (512, 4):  # by bits, or all of a bucket
        check_near(near_groups(docs, NearDup(shingle_words=2, block_rows=16, star_rounds=1, few_rows=few)), rows, 2)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (None, None)]
    found = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), NearDup(shingle_words=2)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == Counter(
        {(None, None, True): 2, (1, 1, True): 2, (2, 1, False): 1}
    )


def test_texts_that_share_an_id_are_judged_by_their_own_sets(spark):
    """Id 1 has forty texts; each has a near copy under an id of its own, and all are linked by id 1."""
    rng, rows = random.Random(5), []
    for d in range(40):
        words = [f"v{d}x{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(1, " ".join(words)), (10 + d, " ".join([*words, "tail"]))]
    rows += [(90, "some words of their own stand here"), (91, "and quite other ones in this place")]
    found = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), NearDup(shingle_words=2)).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(d, 1 if d < 90 else d, d in (1, 90, 91)) for d, _ in rows}


def test_agreement_counts_equal_groups_of_bits():
    rng = np.random.default_rng(1)
    groups = rng.integers(0, 4, (2, 50, 32), dtype=np.uint64)
    packed = (groups.reshape(2, 50, 2, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(-1, dtype=np.uint64)
    assert agreement(packed[0], packed[1], 4).tolist() == (groups[0] == groups[1]).sum(1).tolist()


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert found == wanted


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_sorts_suffixes(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def check_removed(df, rows, length):
    found = {r.doc_id: r for r in df.collect()}
    assert len(found) == len(rows)
    for d, cover in brute.removed(rows, length).items():
        text = dict(rows)[d]
        edges = np.flatnonzero(np.diff(np.array([0, *cover, 0], np.int8)))
        r = found[d]
        kept = bytes(b for b, c in zip(text, cover, strict=True) if not c)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text), sum(cover), len(edges) // 2)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.spans == edges.tolist()


def as_bytes(rows):
    return [(d, (t or "").encode()) for d, t in rows]


def test_remove_repeats(spark, odd_docs, odd_texts, empty_docs, sf):
    check_removed(remove_repeats(odd_docs), as_bytes(enumerate(odd_texts)), 50)
    assert remove_repeats(empty_docs).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_removed(remove_repeats(spark.read.parquet(f"{sf}/documents.parquet")), as_bytes(rows), 50)


def test_remove_repeats_of_few_letters(spark):
    rng = random.Random(6)
    rows = [(d, "".join(rng.choice("ab") for _ in range(rng.randrange(200)))) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = Repeats(length=24, anchor=20, array_bytes=64, part_bytes=2000)
    check_removed(remove_repeats(docs, p), as_bytes(rows), 24)
    copies = [(None, "z" * 70), (5, "z" * 70), (5, "z" * 70), (4, "z" * 70), (None, "z" * 70), (6, "z" * 9)]
    found = remove_repeats(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_removed) for r in found) == Counter({(None, 0): 2, (5, 70): 2, (4, 0): 1, (6, 0): 1})


def check_shards(df, rows):
    found, sizes, groups, slots = {}, Counter(), defaultdict(set), defaultdict(list)
    for r in df.collect():
        found[r.doc_id] = r
        text = (dict(rows)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        sizes[r.shard] += r.size
        groups[dict(rows)[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(found) == len(rows) and all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards(spark, odd_docs, odd_texts, empty_docs, sf):
    check_shards(sharding.shard_documents(odd_docs), list(enumerate(odd_texts)))
    assert sharding.shard_documents(empty_docs).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sizes = check_shards(QUERIES["op2_shard"](spark, sf), rows)
    assert max(sizes.values()) < 1.02 * sum(sizes.values()) / 8
    few_lots = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet"), sharding.Shards(lot_groups=20))
    assert max(check_shards(few_lots, rows).values()) < 1.1 * sum(sizes.values()) / 8


def naive_best_fit(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fit = [(r, b) for b, r in enumerate(room) if r >= sizes[k]]
        if sizes[k] > capacity or not fit:
            room.append(max(0, capacity - sizes[k]))
            out[k] = len(room) - 1
        else:
            out[k] = min(fit)[1]
            room[out[k]] -= sizes[k]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_decreasing_is_best_fit_decreasing(sizes):
    found = sharding.best_fit_decreasing(np.array(sizes, np.int64), 50).tolist() if sizes else []
    load = lambda bins: sorted(Counter({b: sum(s for s, x in zip(sizes, bins, strict=True) if x == b) for b in set(bins)}).values())
    assert load(found) == load(naive_best_fit(sizes, 50))


def test_the_tree_keeps_its_order_through_splits():
    rng, rooms, plain = random.Random(8), sharding.Rooms(), []
    for k in range(5000):
        if rng.random() < 0.7:
            rooms.add(x := rng.randrange(1000), k)
            plain.append((x, k))
        else:
            size = rng.randrange(1000)
            wanted = min((e for e in plain if e[0] >= size), default=None)
            assert rooms.take(size) == wanted
            if wanted:
                plain.remove(wanted)


def test_one_large_group_stands_alone():
    bins = sharding.pack_into(np.array([1000, *[10] * 70], np.int64), 8)
    assert Counter(bins.tolist()) == Counter({0: 1, **{k: 10 for k in range(1, 8)}})


def test_pack_to_capacity(spark):
    groups = spark.range(500).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("group_key"), (F.col("id") % 37 + 1).alias("weight"))
    packed = sharding.pack_to_capacity(groups, 100, lot_shards=8).join(groups, "group_key").groupBy("shard").agg(F.sum("weight").alias("s")).collect()
    total = sum(r.s for r in packed)
    assert max(r.s for r in packed) <= 100 and len(packed) <= 1.15 * total / 100 + 2


def check_archive(df, pages):
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}
    assert found == brute.records(pages)


def test_archives(spark, sf):
    pages = [(1, "u", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "http://a/ b\r\n", "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("best", F.lit(1)).withColumn("sha", F.lit("s"))
    check_archive(warc.archive_round_trip(df, warc.Archive(frame_bytes=200, bundle_bytes=700)), [(p, h) for p, _, h in pages])
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    check_archive(QUERIES["op3_warc"](spark, sf), rows)


def test_frames_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(k, f"u{k}", f"{k} " * 400) for k in range(200)], "page_id long, url string, html string")
    folder = work_dir(spark, "test-warc")
    warc.write_archives(pages, folder, warc.Archive(frame_bytes=8000))
    assert warc.frames(spark, folder).count() >= 16
    read = warc.read_archives(spark, folder)
    assert read.select(F.spark_partition_id().alias("task")).distinct().count() >= 4
    assert read.count() == 200
    assert warc._tasks(spark, 10**6, 64) == 10**6 // 64 and warc._tasks(spark, 0, 64) == 1


def test_lookup_by_record_and_repeated_rows(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "p" * k) for k in range(60)] + [(7, "v", "p" * 7), (None, "n", "n"), (None, "m", "n")], "page_id long, url string, html string")
    folder = work_dir(spark, "test-warc")
    index = warc.write_archives(pages, folder, warc.Archive(frame_bytes=600))
    assert index.filter("frame > 0").count() > 5
    got = warc.fetch(spark, folder, index.filter("page_id = 42 or page_id = 7")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, bytes(r.payload or b"")) for r in got) == Counter(
        {(42, "response", None, b"p" * 42): 1, (7, "response", None, b"p" * 7): 1, (7, "revisit", 7, b""): 1}
    )
    assert index.select("record_id").distinct().count() == 63
    nulls = [r.record_type for r in warc.read_archives(spark, folder).filter("page_id is null").collect()]
    assert len(nulls) == 2


def test_seek_table_is_a_skippable_frame(tmp_path):
    import zstandard

    path = tmp_path / "b.warc.zst"
    with open(path, "wb") as out:
        bundle = warc.Bundle(out, warc.Archive(frame_bytes=50))
        spots = [bundle.add(b"x" * n) for n in (40, 30, 90, 1)]
        bundle.close()
    raw = path.read_bytes()
    assert [s[0] for s in spots] == [0, 1, 2, 3]
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"x" * 161
    import pyarrow.fs

    table = warc.seek_table(pyarrow.fs.LocalFileSystem().open_input_file(str(path)))
    assert [t[2] for t in table] == [40, 30, 90, 1]


HARD = [
    "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[INST!]x[/INST]", "<", "</s", "", None, "a</s></s>", "[INST[INST]]", "$1 \\$1", "\n\r\t", "plain text"
]


def test_chats_come_back_identical(spark):
    rows = [(c, t, role, text) for c in range(3) for t, (text, role) in enumerate(zip(HARD, ["user", "assistant", None, "a[/INST]b", "!", "\\"] * 3, strict=False))]
    rows += [(None, 1, "user", "x"), (9, None, "assistant", "second"), (9, None, "assistant", "first"), (9, 0, "assistant", "third"), (9, 0, "assistant", "third")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(3)).withColumn("level", F.lit("x"))
    chats = chat_format.format_chats(df)
    for r in chat_format.digests(chats).collect():
        own = [(t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(text for _, role, text in own if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(own), digest, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    levels = {r.conv_id: r.level for r in chats.select("conv_id", "level").collect()}
    assert levels[9] == 0 and levels[0] > 0
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_own_conversation_is_escaped(spark, sf):
    found = {r.conv_id: r for r in QUERIES["op9_chat_format"](spark, sf).collect()}
    assert found[-1].n_turns == 2 and found[-1].loss_chars == len("</s>[INST] ok [/INST]")
    assert len(found) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1


def check_mix(df, rows, slack):
    sizes = {d: len(brute.WORD.findall(t or "")) for d, t, _ in rows}
    source = {d: s for d, _, s in rows}
    totals = Counter()
    for d in sizes:
        totals[source[d]] += sizes[d]
    wanted, taken = brute.targets(totals), Counter()
    found = df.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.size, r.source_size) == (sizes[r.doc_id], totals[source[r.doc_id]])
        assert r.target == pytest.approx(wanted[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= max(slack * t, 3)


def test_mix(spark, odd_docs, odd_texts, empty_docs, sf):
    rows = [(k, t, None if k % 5 == 0 else f"s{k % 3}") for k, t in enumerate(odd_texts)]
    check_mix(mixing.mix(odd_docs), rows, 0.01)
    assert mixing.mix(empty_docs).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    check_mix(QUERIES["op10_mix"](spark, sf), rows, 0.01)
    check_mix(mixing.mix(docs, mixing.Mix(shards=4, piece_words=500)), rows, 0.01)
    once, again = (sorted(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert once == again


def test_apportionment_is_highest_quotients(spark):
    rng = random.Random(12)
    for seats in (7, 40):
        weights = [rng.randrange(1, 100) for _ in range(9)]
        total = sum(weights)
        cells = spark.createDataFrame([(k, w * seats / total, seats) for k, w in enumerate(weights)], "name int, ideal double, seats long")
        found = {r.name: r.quota for r in mixing.apportion(cells, [], ["name"], "ideal", "seats", "quota").collect()}
        assert [found[k] for k in range(9)] == brute.sainte_lague(weights, seats)


def test_pages_of_one_template_are_dealt_in_proportion(spark, monkeypatch):
    """Texts at a similarity of 0.68 are no links; some are, at 0.8 and more."""
    from faultline.llm import near_dedup

    dealt = []

    def counted(tasks, *rest):
        tasks = tasks.cache()
        dealt[-1] += tasks.count()
        return plain(tasks, *rest)

    plain = near_dedup.by_key
    monkeypatch.setattr(near_dedup, "by_key", counted)
    shell = " ".join(f"t{k}" for k in range(400))
    for n in (600, 1200, 2400):
        own = lambda k: " ".join(f"u{k}_{j}" for j in range(89))
        rows = [(k, f"{shell} {own(k)}") for k in range(n)]
        rows += [(n + k, f"{shell} {own(k)} x{k}") for k in range(5)] + [(n + 5, f"{shell} {own(0)} other words here")]
        dealt.append(0)
        found = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), NearDup(few_rows=200))
        linked = {r.doc_id: r.component_id for r in found.filter("not kept").collect()}
        assert linked == {**{n + k: k for k in range(5)}, n + 5: 0}
    assert dealt[2] <= 5 * dealt[0] + 100, dealt
    assert dealt[2] < 4 * 2400, dealt


def test_sets_around_the_threshold_meet_by_rare_shingles(spark):
    """Random sets of many sizes that share much: links equal brute force though no bucket is compared by bits."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(150):
        size = rng.randrange(14, 24)
        rows.append((k, " ".join(w for w in words if rng.random() < size / 26)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for params in (NearDup(shingle_words=1, few_rows=0, star_rounds=1), NearDup(shingle_words=2, few_rows=2, block_rows=4)):
        check_near(near_groups(docs, params), rows, params.shingle_words)
