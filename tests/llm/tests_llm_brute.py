"""Plain versions of operators for small tables, with words and sets instead of hashes."""

import collections
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near_groups(texts, width):
    """Smallest id reachable and set size, by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i: i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d in sorted(sets):
        near = {e for s in sets[d] for e in holders[s]}
        for e in near:
            common = len(sets[d] & sets[e])
            if 100 * common >= 80 * (len(sets[d]) + len(sets[e]) - common):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        for s in sets[d]:
            holders[s].append(d)
    return {d: root(d) for d in texts}, {d: len(s) for d, s in sets.items()}


# first and last code points of the scripts that are written without blanks
UNSPACED = [
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x1AAF), (0x1B00, 0x1B7F), (0x3001, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
    (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]


def line_tokens(line):
    """Words, and single characters of scripts without blanks."""
    out, open_word = [], False
    for x in line:
        if any(a <= ord(x) <= b for a, b in UNSPACED):
            out.append(x)
            open_word = False
        elif x in " \t\n\x0b\f\r":
            open_word = False
        elif open_word:
            out[-1] += x
        else:
            out.append(x)
            open_word = True
    return out


def repeated_lines(texts):
    """id -> numbers of its lines that go: all templates of all lines, as tuples of tokens."""
    documents, constant, own = collections.defaultdict(set), {}, []
    for d, text in texts.items():
        for i, line in enumerate((text or "").split("\n")):
            exact = line_tokens(line)
            n = len(exact)
            masked = ["<*>" if re.search("[0-9]", x) else x for x in exact]
            choices = [c for r in range(1, 5) for c in itertools.combinations(range(4), r)] if n >= 8 else [None]
            for w, c in itertools.product([masked, exact], choices):
                cut = collections.defaultdict(list)
                for p in range(3, n):
                    cut[(p - 3) * 4 // (n - 3)].append(w[p])
                fixed = w if c is None else w[:3] + [x for j in c for x in cut[j]]
                size = sum(x != "<*>" for x in fixed)
                if n and 100 * size >= 60 * n:
                    key = (n, c, tuple(fixed))
                    documents[key].add(d)
                    constant[key] = size
                    own.append((d, i, key))
    gone = collections.defaultdict(set)
    for d, i, key in own:
        if constant[key] * (len(documents[key]) - 1) >= 20 and d > min(documents[key]):
            gone[d].add(i)
    return dict(gone)
