"""Plain single-process versions of the operators, and rows with every awkward case."""

import random
import re
from collections import defaultdict

ODD_TEXTS = [None, "", " ", "\n", "\n\n", "x", "Two words", "'re 's'll 　\U0001F600 é\n \t x", "ΑΣ İstanbul", "<|endoftext|>a", "\x00\x01 ok  ", "a" * 700,
             "word " * 3000, "é" * 300 + " 漢字仮名"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `text_` string, key int, `row` int"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40))
                    for _ in range(n))


def documents(seed=0, n=120):
    """Texts with copies, near copies, shared lines and passages; columns with names that operators use themselves."""
    rng = random.Random(seed)
    lines = [sentence(rng, 9) for _ in range(6)]
    passage = sentence(rng, 80)
    texts = []
    for i in range(n):
        t = sentence(rng, rng.choice([3, 20, 60, 200]))
        if i % 5 == 0:
            t = "\n".join([t, rng.choice(lines) + "  ", sentence(rng, 12), "\t" + rng.choice(lines).upper()])
        if i % 7 == 0:
            t += " " + passage
        if texts and i % 6 == 0:
            words = rng.choice(texts).split(" ")
            if i % 12 == 0 and len(words) > 30:
                words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        texts.append(t)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    return [(i, t, "en", "s", len(t or ""), "other", 7, 1) for i, t in rows]


def split_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", lower) if w]


def shingle_set(text, width):
    w = split_words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def jaccard_components(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    common = defaultdict(int)
    for ids in held.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def dedup_lines(rows, min_chars=40, min_docs=5):
    space = " \t\n\x0b\x0c\r"

    def key(line):
        return line.strip(space).translate({c: c + 32 for c in range(65, 91)})

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)]) for x in lines]
        out[i] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
    return out
