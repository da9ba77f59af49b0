"""Plain-Python versions of the operators, straight from their definitions."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near(rows, n, percent=80):
    """doc_id -> (set size, smallest linked id) for (doc_id, text) rows of distinct ids."""
    sets = {d: shingles(t, n) for d, t in rows}
    low = {d: d for d in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def removed(rows, length):
    """doc_id -> covered flags, for (doc_id, bytes) rows of distinct ids."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        cover = bytearray(len(text))
        windows = [text[i : i + length] for i in range(len(text) - length + 1)]
        for i, w in enumerate(windows):
            if w in seen:
                cover[i : i + length] = b"\1" * length
        seen.update(windows)
        out[d] = cover
    return out


def base_counts(text):
    words = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover)


def contamination(docs, items, window=13):
    """doc rows -> (n_words, n_hit, items) in the order of the rows."""
    named = defaultdict(set)
    for i, text in items:
        words = LETTERS.findall((text or "").translate(LOWER))
        for k in range(max(1, len(words) - window + 1)) if words else ():
            named[tuple(words[k : k + window])].add(str(i))
    sizes = {len(w) for w in named}
    out = []
    for _, text in docs:
        words, cover, found = LETTERS.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if hit := named.get(tuple(words[k : k + n])):
                    cover.update(range(k, k + n))
                    found |= hit
        out.append((len(words), len(cover), sorted(found)))
    return out


def verbatim(docs, items, window=13):
    """doc rows -> sorted (doc_word, item, item_word, n_words) of all matches that no word on either side extends."""
    out = []
    for _, text in docs:
        words, found = LETTERS.findall((text or "").translate(LOWER)), set()
        for name, item in set(items):
            own = LETTERS.findall((item or "").translate(LOWER))
            least = min(window, len(own))
            for a in range(len(words) if own else 0):
                for b in range(len(own)):
                    if words[a] != own[b] or (a and b and words[a - 1] == own[b - 1]):
                        continue
                    n = 0
                    while a + n < len(words) and b + n < len(own) and words[a + n] == own[b + n]:
                        n += 1
                    if n >= least:
                        found.add((a, str(name), b, n))
        out.append(sorted(found))
    return out


def records(pages):
    """page_id -> (bytes, digest, type, refers_to) for rows of distinct ids."""
    groups = defaultdict(list)
    for page, html in pages:
        groups[(html or "").encode()].append(page)
    out = {}
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            first = i == max(ids)
            out[i] = (len(payload), digest, "response" if first else "revisit", None if first else max(ids))
    return out


def targets(sizes, weights=(5, 2, 1), percent=150, passes=2):
    """source -> target for source -> size; the excess is reshared until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = sum(sizes.values()) * percent / 100, set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > passes * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = passes * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sainte_lague(weights, seats):
    """Seats by repeated highest quotient; ties go to the first."""
    out = [0] * len(weights)
    for _ in range(seats):
        k = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[k] += 1
    return out


def merkle_leaf(row, lower=False):
    """Leaf of (doc_id, source, lang, n_chars, text)."""
    shown = [None if v is None else str(v) for v in row]
    if lower and shown[4] is not None:
        shown[4] = shown[4].translate(LOWER)
    return _sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle_root(nodes):
    while len(nodes) > 1:
        nodes = [_sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0]


def merkle_siblings(nodes, at):
    """Siblings of one node, level by level up to the root."""
    out = []
    while len(nodes) > 1:
        low = at - at % 8
        out += nodes[low:at] + nodes[at + 1 : low + 8]
        nodes, at = [_sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], at // 8
    return out


def merkle(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row; every version is built anew from all its leaves."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, merkle_leaf(r))) for x in langs}
    base = {x: [merkle_leaf(r) for r in trees[x]] for x in langs}
    subroots = [merkle_root(base[x]) for x in langs]
    out = []
    for k, x in enumerate(langs):
        for at, r in enumerate(trees[x]):
            changed = merkle_leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            folded = merkle_root([*subroots[:k], merkle_root([*base[x][:at], changed, *base[x][at + 1 :]]), *subroots[k + 1 :]])
            proof = _sha("".join(merkle_siblings(base[x], at) + merkle_siblings(subroots, k)))
            out.append((r[0], base[x][at], subroots[k], merkle_root(subroots), proof, folded))
    return out


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spelling(rows):
    """word -> (form, root, n, n_near, form_n) for (doc_id, text) rows, comparing all words with all."""
    seen = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= 7
    n = {w: c for w, c in seen.items() if c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]
