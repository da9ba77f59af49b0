"""The Merkle manifest against trees that plain Python builds anew for every version."""

import zlib
from collections import Counter, defaultdict

import brute
import pytest

from faultline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, rows, height=merkle.HEIGHT):
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), height).collect()
    shown = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in found)
    assert shown == Counter(brute.merkle(rows))
    assert all(r.verified == (r.folded_root == r.root) for r in found)
    return found


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9), (1, 7, 64, 65), (3, 513)])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(100 * k + i, f"s{i % 3}", f"l{k}", i, f"Text {k} {i}") for k, n in enumerate(sizes) for i in range(n)]
    found = check(spark, rows)
    hit = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 0]
    assert {r.doc_id for r in found if not r.verified} == {r.doc_id for r in hit}


def test_more_languages_than_one_run_and_blocks_that_end_anywhere(spark):
    """Blocks of two levels, so that three passes are needed below the languages' roots and two above."""
    rows = [(i, "s", "hot", 5, f"T{i}") for i in range(1100)]
    check(spark, rows + [(5000 + i, None, f"x{i}", None, "a B") for i in range(70)], 2)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", None, 1, "B"), (4, "a", None, 1, ""), (4, "a", "", 1, "QQ"), (4, "b", "", 1, "QQ")]
    check(spark, rows + [(9, "a", "é", 3, "ÀB"), (9, "a", "é", 3, "ÀB"), (9, "a", "z", 3, "x" * 300_000)])


def test_odd_documents_empty_table_and_clashing_columns(spark, odd_texts):
    rows = [(k, None if k % 5 == 0 else f"s{k % 3}", "en" if k % 2 else None, 7, t) for k, t in enumerate(odd_texts)]
    names = ["tree", "pos", "leaf", "root", "path", "row", "spot", "part", "digest"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    found = merkle.manifest(docs).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in found) == Counter(brute.merkle(rows))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_a_version_copies_one_path_and_shares_all_other_nodes(spark):
    rows = [(i, "s", "ab"[i % 2] if i % 7 else None, 5, f"Text {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = {tuple(r) for r in merkle.base_nodes(docs).collect()}
    assert plain == {tuple(r) for r in merkle.base_nodes(docs, 1).collect()}
    base = {(r.upper, r.tree, r.level, r.pos): r.digest for r in merkle.base_nodes(docs).collect()}
    leaf_count = Counter(tree for upper, tree, level, _ in base if not upper and not level)
    assert leaf_count == Counter("=" + r[2] if r[2] else "" for r in rows)
    own = defaultdict(list)
    for r in merkle.versions(docs).collect():
        own[r.doc_id, r.tree, r.pos].append((r.level, r.digest))
    folded = {r[0]: (r[1], r[5]) for r in brute.merkle(rows)}
    assert {d for d, _, _ in own} == {d for d in folded if zlib.crc32(str(d).encode()) % 3 == 0}
    trees = sorted(leaf_count)
    for (d, tree, pos), copied in own.items():
        copied = [node for _, node in sorted(copied)]
        levels = max(level for upper, t, level, _ in base if not upper and t == tree)
        assert len(copied) == 1 + levels + 1  # one level above the three languages' roots
        # read the version: a copied node where there is one, the shared base node elsewhere
        view = dict(base)
        for level in range(levels + 1):
            view[False, tree, level, pos // 8**level] = copied[level]
        view[True, "", 0, trees.index(tree)], view[True, "", 1, 0] = copied[levels], copied[levels + 1]
        for (upper, t, level, at), node in view.items():
            if level:
                below = [view[upper, t, level - 1, i] for i in range(8 * at, 8 * at + 8) if (upper, t, level - 1, i) in view]
                assert node == merkle.digest("".join(below))
        assert base[False, tree, 0, pos] == folded[d][0] and view[True, "", 1, 0] == folded[d][1]
