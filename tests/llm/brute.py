"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from tokenizers import Tokenizer

from hirelake.llm import language_id
from hirelake.llm.tokens import public_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_tokenizer = None


def words(text):
    return WORD.findall(text or "")


def ids(text):
    global _tokenizer
    if _tokenizer is None:
        _tokenizer = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))
    return _tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def simhash(text, size=3):
    own = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = words(own)
    if not own:
        return 0
    shingles = [own[i : i + size] for i in range(max(1, len(own) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Least node reachable from each."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def near_duplicates(docs, bits=2):
    """{doc_id: (hex, component)} of (doc_id, text) pairs."""
    prints = {d: simhash(t) for d, t in docs}
    roots = groups(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= bits)
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    return {d: (f"{p:016x}", least[roots[p]]) for d, p in prints.items()}


def stays(docs, window=20):
    """{doc_id: (words, whether each stays)}; docs in order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        own = words(text)
        keep = [True] * len(own)
        for i in range(len(own) - window + 1):
            gram = tuple(own[i : i + window])
            if gram in seen:
                keep[i : i + window] = [False] * window
            seen.add(gram)
        out[doc_id] = own, keep
    return out


def removed(docs, window=20):
    out = {}
    for doc_id, (own, keep) in stays(docs, window).items():
        kept = " ".join(w for w, k in zip(own, keep) if k)
        out[doc_id] = (len(own), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, size=5):
    own = plain(text)
    return {" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def contained(docs, items, threshold=0.8):
    """{(doc_id, item_id): (shared, of)}"""
    own = {d: {size: shingles(t, size) for size in range(1, 6)} for d, t in docs}
    found = {}
    for item, text in items:
        wanted = shingles(text)
        size = min(5, len(plain(text)))
        for d, s in own.items():
            if wanted and len(wanted & s[size]) >= threshold * len(wanted) - 1e-9:
                found[d, item] = (len(wanted & s[size]), len(wanted))
    return found


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)"""
    text = text or ""
    own = words(text)
    grams = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    n, chars = len(own), sum(map(len, own))
    symbols, again = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    upper = sum(c.isupper() for c in text)
    failed = n < 20 or 100 * len(covered) > 30 * n
    bad = 10 * symbols > n or 10 * upper > 3 * chars or 10 * text.count("!!") > n
    bad = bad or 2 * again > len(lines) or chars < 2 * n or chars > 15 * n
    return n, chars, symbols, again, len(covered), failed, not (failed or bad)


def language(docs, penalty):
    """{doc_id: (label, share of letters)} of (doc_id, text, lang) rows, learned from all but every fourth by checksum."""
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 4 == 2
    runs = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    learned = [(lang, w) for d, t, lang in docs if lang is not None and not held(d) for w in runs(t)]
    names = sorted({lang for lang, _ in learned})
    script = language_id.script
    padded = lambda w: f"{language_id._START * 2}{w}{language_id._END}"
    three, used = {x: Counter() for x in names}, {x: Counter() for x in names}
    for lang, w in learned:
        used[lang][script(w)] += len(w)
        three[lang].update(padded(w)[i - 2 : i + 1] for i in range(2, len(w) + 3))
    shorter = {x: (Counter(), Counter(), Counter(), Counter()) for x in names}
    for x in names:
        two, one, ctx3, ctx2 = shorter[x]
        for g, n in three[x].items():
            two[g[1:]] += n
            one[g[2]] += n
            ctx3[g[:2]] += n
            ctx2[g[1]] += n

    def scores(w):
        out = []
        for x in names:
            two, one, ctx3, ctx2 = shorter[x]
            s = 0.0
            for i in range(2, len(w) + 3):
                g = padded(w)[i - 2 : i + 1]
                p = (one[g[2]] + 1e-3) / (sum(one.values()) + 1.0)
                p = (two[g[1:]] + 5 * p) / (ctx2[g[1]] + 5)
                s += np.log((three[x][g] + 5 * p) / (ctx3[g[:2]] + 5))
            out.append(s)
        allowed = [used[x][script(w)] * 100 >= max(1, sum(used[x].values())) for x in names]
        return [s if a else language_id.NEVER for s, a in zip(out, allowed)] if any(allowed) else [0.0] * len(names)

    known, out = {}, {}
    for d, t, _ in docs:
        own = runs(t)
        if not own:
            out[d] = "und", 0.0
            continue
        value, back = None, []
        for w in own:
            if w not in known:
                known[w] = scores(w)
            if value is None:
                value = known[w]
                continue
            best = max(range(len(names)), key=lambda k: value[k])
            back.append([k if value[k] >= value[best] - penalty else best for k in range(len(names))])
            value = [max(v, value[best] - penalty) + s for v, s in zip(value, known[w])]
        path = [max(range(len(names)), key=lambda k: value[k])]
        for step in reversed(back):
            path.append(step[path[-1]])
        letters = [sum(len(w) for w, k in zip(own, reversed(path)) if k == x) for x in range(len(names))]
        first = max(range(len(names)), key=lambda k: letters[k])
        out[d] = names[first], letters[first] / sum(letters)
    return out
