"""Plain versions of the operators, one document or all pairs at a time, and fixtures that hold the odd cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns with names that operators use themselves.
EXTRA = "score double, shard int, size bigint, fingerprint string, rejected_by string, n_words bigint, fp bigint, id string, blob string, hash bigint, item string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))


def dirty(spark, rows=None):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, characters beyond ASCII and the basic plane."""
    extra = (0.5, 3, 9, "f", "r", 1, 2, "i", "b", 4, "t")
    texts = rows if rows is not None else [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b"), (3, None, None, None),
        (4, "", "en", ""), (5, " \t\n\x0b\x0c\r ", "fr", "a"), (6, "one", "en", "c"), (6, "one", "en", "c"), (6, "two words", "de", "c"), (None, "no id here at all", "en", "a"),
        (None, "no id here at all", "en", "a"), (8, LONG, "en", "a"), (9, "\U0001f600 é ß x password = hunter22 \U0001f600 AKIA" + "B" * 16 + " " + "0af9" * 8, None, "b"),
        (10, "a\n\nb\na\nb\n a\nsame line here\nsame line here", "en", None), (11, "### $$$ %%% &&& ||| <<< >>>", "xx", "z"), (12, "x y z x y z x y z x y z x y z x y z", "en", "b")]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, *extra) for i, t, lang, s in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Source to target: the excess of limited sources is dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left, whole = total - sum(fixed.values()), sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed.update({s: float(most * sizes[s]) for s in above})


SECRET = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
          ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def secrets(text):
    found = []
    for place, (kind, pattern, group, least) in enumerate(SECRET):
        found += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def measures(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if many[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def fingerprint(text, width=3):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if len(w) >= width else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Node to the set of nodes it reaches, comparing all pairs."""
    left, out = set(nodes), {}
    while left:
        group, rim = set(), {left.pop()}
        while rim:
            x = rim.pop()
            group.add(x)
            near = {y for y in left if linked(x, y)}
            left -= near
            rim |= near
        out.update(dict.fromkeys(group, group))
    return out


def simhash_classes(rows, bits=3, width=3):
    """(id, fingerprint, component) of rows (id, text)."""
    fps = [(i, fingerprint(t, width)) for i, t in rows]
    of = components({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= bits)
    ids = defaultdict(list)
    for i, f in fps:
        ids[f].append(i)
    return [(i, f"{f:016x}", min((x for g in of[f] for x in ids[g] if x is not None), default=None)) for i, f in fps]


def payload_digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def crc(text):
    return zlib.crc32(text.encode())


def pieces(text, vocabulary, mark="▁"):
    """Greedy longest match, piece by piece; characters that are no piece count as their bytes."""
    vocabulary, total = set(vocabulary), 0
    most = max(map(len, vocabulary), default=1)
    for word in words(text):
        rest = mark + word
        while rest:
            n = next((k for k in range(min(most, len(rest)), 0, -1) if rest[:k] in vocabulary), 0)
            total += 1 if n else len(rest[0].encode())
            rest = rest[n or 1 :]
    return total


BARE = re.compile(r"[\W_]+")


MARKS = str.maketrans({chr(i): " " for i in range(1, 7)})


def template(text, units, spelled):
    """(template token, slot value or None) of the words with a letter or digit."""
    words_, stuck = [], re.compile(f"([0-9]+)({'|'.join(units)})", re.I)
    for x in words((text or "").translate(MARKS)):
        bare, stop = BARE.sub("", x), bool(re.search(r"[.!?:][\W_]*$", x))
        m = stuck.fullmatch(bare)
        if m:
            words_ += [(m[1], False), (m[2], stop)]
        elif bare or stop:
            words_.append((bare, stop))
    runs = []
    for bare, stop in words_:
        if runs and bare[:1].isupper() and runs[-1][0][:1].isupper() and not runs[-1][1]:
            runs[-1] = (runs[-1][0] + "\x03" + bare, stop)
        else:
            runs.append((bare, stop))
    out, counted = [], False
    for plain, _ in runs:
        number = bool(re.fullmatch("[0-9]+", plain)) or plain.lower() in spelled
        if number:
            out.append(("<number>", plain))
        elif plain[:1].isupper():
            out.append(("<name>", plain))
        elif plain.lower() in units and counted:
            out.append(("<unit>", plain))
        elif plain:
            out.append((plain.lower(), None))
        counted = number
    return out


def literal(text):
    bare = [BARE.sub("", w).lower() for w in words((text or "").translate(MARKS))]
    return [(b, None) for b in bare if b]


def traces(docs, items, units, spelled, width=5, coverage=0.8, literals=2, run=20, least_words=10):
    """Document id to item ids, every document against every item."""
    def cut(toks, n):
        got = []
        for i in range(len(toks) - n + 1):
            part = toks[i : i + n]
            slots = [s for _, s in part if s is not None]
            name = tuple(t for t, _ in part)
            got.append((i, name if n - len(slots) >= min(literals, n) else (name, tuple(slots)), slots))
        return got

    def forms(text):
        return template(text, units, spelled), literal(text)

    def holds(toks, it):
        if not it:
            return False
        n, first = min(width, len(it)), {}
        for at, key, slots in cut(it, n):
            first.setdefault(key, (at, slots))
        lines = defaultdict(list)
        for at, key, slots in cut(toks, n):
            if key in first:
                place, mine = first[key]
                band = (at - place) // max(1, len(it) // 4)
                for line in (("d", at - place), ("b", band), ("b", band - 1)):
                    lines[line].append((place, list(zip(mine, slots, strict=True))))
        for (kind, _), hits in lines.items():
            pairs = {p for _, ps in hits for p in ps}
            if len({a for a, _ in pairs}) < len(pairs):
                continue
            places = {p for p, _ in hits}
            covered = len({k for p in places for k in range(p, p + n)})
            longest = max(next(k for k in range(1, len(it) + 2) if p + k not in places) for p in places) + n - 1
            if len(places) >= coverage * len(first) - 1e-9 or (covered >= max(least_words, coverage * len(it) - 1e-9)) or (kind == "d" and longest >= run):
                return True
        return False

    prepared = [(i, forms(t)) for i, t in items]
    found = {}
    for doc, text in docs:
        mine = forms(text)
        hit = sorted({i for i, its in prepared if i is not None and any(holds(a, b) for a, b in zip(mine, its, strict=True))})
        if hit or any(any(holds(a, b) for a, b in zip(mine, its, strict=True)) for i, its in prepared if i is None):
            found[doc] = hit
    return found


def shingles(text):
    words_ = (text or "").encode().lower().split()
    return frozenset(tuple(words_[i : i + 5]) for i in range(max(1, len(words_) - 4))) if words_ else frozenset()


def near_groups(rows, similar=0.8):
    """Id to the least id of its group: the five-word shingles of every text against those of every other."""
    sets = {i: shingles(t) for i, t in rows}
    found = components(set(sets.values()), lambda a, b: a == b or len(a & b) >= similar * len(a | b))
    ids = defaultdict(list)
    for i, s in sets.items():
        ids[s].append(i)
    return {i: min(x for g in found[s] for x in ids[g]) for i, s in sets.items()}
