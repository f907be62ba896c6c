"""Small tables with the hard cases, and brute-force versions of the operators."""

import hashlib
import random
import re
from itertools import combinations

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key long, n long, words string, "
          "place string, shard int, score double, label int, id string, spans string, keep_text string, blob string")
EXTRA = (7, 8, "w", "p", 1, 0.5, 1, "i", "s", "k", "b")  # columns whose names operators use inside


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def documents(seed: int = 1, copies: int = 30) -> list[tuple]:
    """Nulls, empty and short texts, a very long text, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(seed)
    shared = prose(rng, 45)
    base, long = prose(rng, 120), prose(rng, 6000)
    texts = [None, "", " \n\t ", "One", "one", "two words", "a b c d", "a b c d e", "A  B\tC d\ne", long, long, base]
    words = base.split()
    for i in range(copies):  # near copies: one to six words changed
        w = list(words)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [base] * 5
    for i in range(25):
        texts.append(f"{prose(rng, rng.randint(5, 60))} {shared} {prose(rng, rng.randint(0, 60))}")
    for size in range(1, 14):  # light sets, and the same with one word more or less
        t = prose(rng, size + 4).split()
        texts += [" ".join(t), " ".join([*t, "more"]), " ".join(t[1:])]
    texts += ["la la " * 40, "çà é été — «ün» " * 9, "é" * 50]
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    rows += [rows[9], rows[9], (rows[12][0], "another text with an id that is taken " + shared)]  # repeated row; same id
    rows += [(None, base), (None, "text without an id " + shared), (None, None)]
    rng.shuffle(rows)
    return rows


def table(spark, rows, partitions: int = 5):
    full = [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", None if t is None else len(t), *EXTRA)
            for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = split(fold(text))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def linked(rows, k=5, least_share=75):
    """component and class of each row (ids may be null)."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least_share * len(sets[i] | sets[j]):
            root[find(i)] = find(j)

    def least(members):
        return min((rows[i][0] for i in members if rows[i][0] is not None), default=None)

    groups, classes = {}, {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
        classes.setdefault(sets[i], []).append(i)
    return [(rows[i][0], len(sets[i]), least(classes[sets[i]]) if sets[i] else rows[i][0],
             least(groups[find(i)]) if sets[i] else rows[i][0]) for i in range(len(rows))]


def unrepeated(rows, length=20):
    """(id, words, removed, digest) of each row; rows are ordered as the operator states."""
    def order(row):
        return (row[0] is None, row[0] or 0)

    # documents with equal ids and other words are ordered by the operator's digest: the cases avoid repeats there
    distinct = {(r[0], tuple(split(r[1]))) for r in rows}
    first = {}
    for row in sorted(distinct, key=order):
        for i in range(len(row[1]) - length + 1):
            first.setdefault(row[1][i:i + length], (row, i))
    out = []
    for i, t in rows:
        w = tuple(split(t))
        gone = set()
        for s in range(len(w) - length + 1):
            if first[w[s:s + length]] != ((i, w), s):
                gone.update(range(s, s + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def alphanumeric(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def contaminated(rows, items, length=10):
    windows = {}
    for item, t in items:
        w = alphanumeric(t)
        k = min(length, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for doc, t in rows:
        w = alphanumeric(t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (owners := windows.get(tuple(w[i:i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= owners
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def secrets(text):
    kinds = [("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = [(m.start(), no, kind, m.end()) for no, (kind, pattern, group, least) in enumerate(kinds)
             for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(s, kind, e) for s, _, kind, e in sorted(found)]


def packed(rows, capacity):
    """Best fit by trying every bin; rows (id, length, source, cluster) in packing order."""
    bins, out, members = [], [], {}
    for r in rows:
        members[r[3]] = members.get(r[3], 0) + 1
    for doc, length, source, cluster in rows:
        if not length:
            out.append((doc, 0, 0, 0, None, None))
            continue
        whole, rest = divmod(length, capacity)
        for p in range(whole):
            out.append((doc, p, p * capacity, capacity, len(bins), 0))
            bins.append([0, set(), set()])
        if rest:
            fits = [(room, i) for i, (room, sources, clusters) in enumerate(bins)
                    if room >= rest and (source is None or source not in sources) and cluster not in clusters]
            if not fits:
                bins.append([capacity, set(), set()])
            i = min(fits)[1] if fits else len(bins) - 1
            out.append((doc, whole, whole * capacity, rest, i, capacity - bins[i][0]))
            bins[i][0] -= rest
            if source is not None:
                bins[i][1].add(source)
            if members[cluster] > 1:
                bins[i][2].add(cluster)
    return out
