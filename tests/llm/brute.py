"""Plain single-process versions of the queries, straight from what they promise."""

import base64
import collections
import fractions
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def shingles(text, gram=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + gram]) for i in range(max(1, len(words) - gram + 1))} if words else set()


def components(rows, gram=4, percent=85):
    """[(id, text)] -> [(id, shingles, component)]"""
    sets = [shingles(t, gram) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for token in s:
            lists[token].append(i)
    for i, s in enumerate(sets):
        common = collections.Counter(j for token in s for j in lists[token] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[find(i)] = min(key, smallest.get(find(i), key))
    return [(key, len(sets[i]), smallest.get(find(i))) for i, (key, _) in enumerate(rows)]


def warc(rows):
    """[(page, html)] -> [(page, bytes, digest, kind, refers)]"""
    digests = [(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for p, b in ((p, (h or "").encode()) for p, h in rows)]
    first = {}
    for page, _, digest in digests:
        if page is not None:
            first[digest] = min(page, first.get(digest, page))
    return [(p, n, d, "response", None) if p is None and d not in first or p == first.get(d) else (p, n, d, "revisit", first[d]) for p, n, d in digests]


def line_dedup(rows, least=10):
    def key(line):
        bare = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
        return bare if len(bare) >= least else None

    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and key(line) is not None:
                owner[key(line)] = min(doc, owner.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or key(x) is None or owner[key(x)] >= doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def token_rows(rows, end=1):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def bpe(rows):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc, text in rows:
        ids = own.encode_ordinary(text or "")
        out.append((doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    return out


def quality_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def periodic_runs(words, least_words=24, least_periods=3):
    """(start, length, period), by trying every period."""
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            part = words[s:s + length]
            if length >= max(least_words, least_periods * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = periodic_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()))


def pieces(rows):
    """Token count and digests by the library itself."""
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        out.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    return out


def phrase_rows(rows, longest=4, least=30, inside=80, most=2000):
    """[(text, lang)] -> (lang, rank, phrase, a, l, r, n, score), by counting every window."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts[lang].update(tuple(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        big = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        covered = set()
        for g, a in big.items():
            covered |= {g[i:i + k] for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= inside * f[g[i:i + k]]}
        scored = []
        for g, a in big.items():
            if g not in covered:
                score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:most])]
    return out
