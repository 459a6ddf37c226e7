"""Plain restatements of the contracts, for small inputs."""
import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def runs(flags):
    return len(re.findall(b"\1+", bytes(flags)))


def suffix(docs, length=200):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(r[k:k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        out.append((i, len(r), sum(gone), runs(gone), hashlib.sha256(bytes(x for x, g in zip(r, gone) if not g)).hexdigest()))
    return out


def windows(docs, length=20):
    """Distinct rows only; repeated ones are one document."""
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in sorted(words, key=lambda x: (x[0] is not None, x[0] or 0)):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p:p + length]), (i, p))
    out = []
    for i, w in words:
        gone = [0] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p:p + length])] != (i, p):
                gone[p:p + length] = [1] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def near(docs, percent=85):
    sets, up = [shingles(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(docs)]


def contained(docs, items, percent=80):
    out = []
    for j, t in items:
        k = min(5, len(WORD.findall(t or "")))
        own = shingles(t, k) if k else frozenset()
        for i, text in docs:
            w = WORD.findall(lower(text))
            both = len(own & {tuple(w[p:p + k]) for p in range(len(w) - k + 1)})
            if own and 100 * both >= percent * len(own):
                out.append((i, j, len(own), both))
    return out


def weighted_jaccard(a, b):
    a, b = (collections.Counter(WORD.findall(lower(t))) for t in (a, b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def base_scores(docs):
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for k, (i, _) in enumerate(docs)}
    words = [WORD.findall(lower(t)) + ["\n"] for _, t in docs]
    c = collections.Counter(w for k, ws in enumerate(words) if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held[k], len(words[k]), sum(c[w] > 0 for w in words[k]), n, sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in words[k])) for k, (i, _) in enumerate(docs)]


def tree_ln(counts, context, depth, d=0):
    """ln of the weighted probability of one bit's node and everything deeper; counts: {context bytes: (zeros, ones)}, contexts of ``depth`` bytes, nearest last."""
    zeros = sum(z for c, (z, o) in counts.items() if c.endswith(context))
    ones = sum(o for c, (z, o) in counts.items() if c.endswith(context))
    own = math.lgamma(zeros + .5) + math.lgamma(ones + .5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)
    if d == depth:
        return own
    kids = {c[len(c) - d - 1:] for c in counts if c.endswith(context)}
    total = sum(tree_ln(counts, k, depth, d + 1) for k in kids)
    m = max(own, total)
    return m + math.log(.5 * math.exp(own - m) + .5 * math.exp(total - m))


def tree_scores(docs, depth):
    """log10 probability of each document: context-tree mixing by dictionaries over bytes, one bit at a time."""
    texts = [bytes(depth).replace(b"\0", b"\n") + " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))).encode() + b"\n" for _, t in docs]
    counts = collections.defaultdict(lambda: [0, 0])
    for (i, _), t in zip(docs, texts):
        if i is None or zlib.crc32(str(i).encode()) % 10:
            for k in range(depth, len(t)):
                for j in range(8):
                    for d in range(depth + 1):
                        counts[t[k - d:k], 1 << j | t[k] >> (8 - j)][t[k] >> (7 - j) & 1] += 1
    kids = collections.defaultdict(list)
    for c, prefix in counts:
        if c:
            kids[c[1:], prefix].append((c, prefix))
    memo = {}

    def own(node):
        z, o = counts[node]
        return math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def weighted(node):
        if node not in memo:
            memo[node] = own(node) if len(node[0]) == depth else max(a := own(node), b := sum(map(weighted, kids[node]))) + math.log1p(math.exp(-abs(a - b))) - math.log(2)
        return memo[node]

    def one(node):
        z, o = counts[node]
        return (o + .5) / (z + o + 1)

    out = []
    for t in texts:
        ln = 0.0
        for k in range(depth, len(t)):
            for j in range(8):
                path = [(t[k - d:k], 1 << j | t[k] >> (8 - j)) for d in range(depth + 1)]
                path = [x for x in path if x in counts]
                p = one(path[-1]) if path else .5
                for node in reversed(path[:-1] if len(path) == depth + 1 else path):
                    share = math.exp(own(node) - math.log(2) - weighted(node))
                    p = share * one(node) + (1 - share) * p
                ln += math.log(p if t[k] >> (7 - j) & 1 else 1 - p)
        out.append(ln / math.log(10))
    return out


def equal_texts(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for i, t in docs:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def turn_key(turn, role, text):
    return turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def trie(rows):
    """Nodes of the rebuilt conversations, by dictionaries of whole prefixes."""
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t, role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v, key=lambda x: turn_key(*x))] for c, v in convs.items()}
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole)))
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        n = len(members[k])
        ends = ",".join(str(c) for c in sorted(c for c, size in members[k] if size == len(k)))
        out[k] = (min(members[k])[0], len(k), min(members[k[:-1]])[0] if k else None, n, len(kids[k]), sum(out[c][5] for c in kids[k]) or 1,
                  sum(out[c][6] for c in kids[k]) + ((n - 1) * len(k[-1][1]) if k else 0), hashlib.sha256(ends.encode()).hexdigest())
    return list(out.values())


def damaged(rows):
    out = collections.defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out[c] += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repairs(convs):
    """All ways from each turn and state, tried out."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    out = []
    for c, turns in convs.items():
        turns = sorted(turns, key=lambda x: turn_key(*x))
        seen, faults = set(), []
        for _, role, text in turns:
            end = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))

        memo = {}

        def best(i, state, inserts):
            if (i, state, inserts) not in memo:
                ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
                options = [("I", 5, i, x, inserts + 1, (x + ":",)) for x in ("user", "assistant") if inserts < 3]
                if i < len(turns):
                    _, role, text = turns[i]
                    options.append(("D", 2, i + 1, None, 0, ()))
                    if faults[i] not in ("blank", "duplicate"):
                        more = 5 * (faults[i] == "truncated")
                        options += [("K", more, i + 1, role, 0, (f"{role}:{text}",)), *[("R", 1 + more, i + 1, x, 0, (f"{x}:{text}",)) for x in ("user", "assistant")]]
                for letter, cost, j, role, k, line in options:
                    if role is None or role[:1] and role[0] in follow[state]:
                        cost2, audit, lines = best(j, state if role is None else role[0], k)
                        ways.append((cost + cost2, letter + audit, line + lines))
                memo[i, state, inserts] = min(ways, default=(10 ** 9, "", ()))
            return memo[i, state, inserts]

        for i in range(len(turns), 0, -1):  # keeps the recursion shallow
            for state in follow:
                best(i, state, 0)
        cost, audit, lines = best(0, "", 0)
        numbers = {t for t, _, _ in turns if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out
