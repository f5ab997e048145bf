"""Plain versions of the document operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MARK_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs, window=13):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}."""
    return {d: r for (d, _), r in zip(docs, substring_rows(docs, window), strict=True)}


def substring_rows(docs, window=13):
    """The same for each row; ids may repeat or be null."""
    least, out = {}, []
    for doc_id, text in docs:
        words = SPACE_WORDS.findall(text or "")
        for i in range(len(words) - window + 1 if doc_id is not None else 0):
            run = tuple(words[i:i + window])
            least[run] = min(doc_id, least.get(run, doc_id))
    for doc_id, text in docs:
        words = SPACE_WORDS.findall(text or "")
        gone = {k for i in range(len(words) - window + 1 if doc_id is not None else 0)
                if least[tuple(words[i:i + window])] < doc_id for k in range(i, i + window)}
        out.append((len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def decontamination(docs, items, window=10):
    phrases = defaultdict(set)
    for item, text in items:
        words = MARK_WORDS.findall(lower(text))
        for i in range(max(len(words) - window + 1, min(1, len(words)))):
            phrases[tuple(words[i:i + window])].update([] if item is None else [str(item)])
    out = {}
    for doc_id, text in docs:
        words, hit, found = MARK_WORDS.findall(lower(text)), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in phrases:
                    hit.update(range(i, i + n))
                    found |= phrases[tuple(words[i:i + n])]
        out[doc_id] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def shingles(text, size):
    words = SPACE_WORDS.findall(lower(text))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def near_duplicates(docs, size, percent):
    sets = {d: shingles(t, size) for d, t in docs}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in holders[s])
        for o, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                up[max(top(d), top(o))] = min(top(d), top(o))
        for s in sets[d]:
            holders[s].append(d)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


_ASSIGN = re.compile("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
                     "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    text = text or ""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    n = Counter(s[0] for s in found)
    return n["assign"], n["access"], n["hex"], sha(",".join("%s:%d:%d" % s for s in found)), ["%s:%d:%d" % s for s in found]


def rule_statistics(text):
    text = text or ""
    words, seen = SPACE_WORDS.findall(text), defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i:i + 3])].append(i)
    repeated = {k for at in seen.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def licenses(text, phrases, templates, containment=0.8):
    words, places, base = MARK_WORDS.findall(lower(text)), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 0.0
    for line in lower(text).split("\n"):
        own = set(MARK_WORDS.findall(line))
        for label, texts in templates.items():
            for t in texts:
                t = set(MARK_WORDS.findall(lower(t)))
                if len(own & t) / len(t) >= containment:
                    labels.add(label)
                    score = max(score, len(own & t) / len(t))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score)


def jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at
