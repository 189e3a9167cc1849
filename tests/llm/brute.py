"""Plain versions of the operators, for small tables."""

import re


def shingle_set(text, n, word=r"[^\x20\x09-\x0D]+"):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(word, lowered)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_components(rows, n, percent=80):
    """(doc_id, text) rows to {index: (size, component_id, kept)}; ids must not be null."""
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(i)
    seen = set()
    for i, own in enumerate(sets):
        for j in {j for x in own for j in holders[x] if j < i}:
            common = len(own & sets[j])
            if (i, j) not in seen and 100 * common >= percent * (len(own) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {i: (len(sets[i]), least[root(i)], least[root(i)] == rows[i][0]) for i in range(len(rows))}


def repeated(texts, length):
    """Per text: (n_bytes, removed runs, kept bytes)."""
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs, i = [], 0
        while i < len(d):
            j = i
            while j < len(d) and gone[j]:
                j += 1
            if j > i:
                runs.append((i, j))
            i = max(j, i + 1)
        out.append((len(d), runs, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def hit_words(texts, items, window, word=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    """Per text: (n_words, n_hit, sorted ids of the items with occurring windows)."""

    def words(t):
        return re.findall(word, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    wanted = {}
    for item, t in items:
        own = words(t)
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if size else ():
            wanted.setdefault(tuple(own[i : i + size]), set()).add(item)
    sizes = {len(w) for w in wanted}
    out = []
    for t in texts:
        own, hit, ids = words(t), set(), set()
        for size in sizes:
            for i in range(len(own) - size + 1):
                if found := wanted.get(tuple(own[i : i + size])):
                    ids |= found
                    hit.update(range(i, i + size))
        out.append((len(own), len(hit), sorted(x for x in ids if x is not None)))
    return out


def greedy_pieces(text, pieces):
    """Number of longest-match pieces of a text; pieces don't cross words with the blank before them."""
    known, longest = set(pieces), max(map(len, pieces))
    total = 0
    for part in re.findall(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= ?[^\x20\x09-\x0D])|[\x20\x09-\x0D]+", (text or "").encode()):
        i = 0
        while i < len(part):
            i += next(n for n in range(min(longest, len(part) - i), 0, -1) if part[i : i + n] in known)
            total += 1
    return total
