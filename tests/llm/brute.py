"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mixed(docs, budgets, epochs, seed):
    """Rows (doc_id, leaf, epoch, taken) of each leaf's budget: docs are (doc_id, text, leaf)."""
    out = []
    for leaf, budget in budgets.items():
        for epoch in range(epochs):
            place = lambda d: (hashlib.md5(f"{seed}:{epoch}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] or 0, len(words(d[1])))  # noqa: B023, E731
            own = sorted((d for d in docs if d[2] == leaf), key=place)
            whole = sum(len(words(d[1])) for d in own)
            if budget <= 0 and (whole or epoch):
                break
            if budget >= whole:
                out += [(d[0], leaf, epoch, len(words(d[1]))) for d in own]
                budget -= whole
                continue
            at = 0
            for d in own:
                if at < budget:
                    out.append((d[0], leaf, epoch, min(len(words(d[1])), budget - at)))
                at += len(words(d[1]))
            break
    return out


def _least_reached(nodes, links):
    """Each node's least node reachable by links."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, n=5):
    w = words(lower(text or ""))
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similar(a: set, b: set, percent=80) -> bool:
    k = len(a & b)
    return bool(a) and bool(b) and 100 * k >= percent * (len(a) + len(b) - k)


def ngram_components(docs):
    """(doc_id, number of shingles, component) of documents (doc_id, text) with ids of their own."""
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similar(sets[a], sets[b])]
    least = _least_reached(ids, links)
    return {(i, len(sets[i]), least[i]) for i in ids}


def fuzzy_lines(docs, percent=80, size=5):
    """doc_id: (number of lines, removed line numbers), comparing all pairs of lines."""
    at = {(i, k): lower(s) for i, t in docs for k, s in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", s)}
    grams = {k: {s[i : i + size] for i in range(max(len(s) - size + 1, 1))} for k, s in at.items()}
    keys = sorted(at)
    first = {}
    for k in keys:
        first.setdefault(at[k], k)
    links = [(first[at[k]], k) for k in keys if first[at[k]] != k]
    distinct = sorted(first.values())
    links += [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if 5 * len(grams[a]) >= 4 * len(grams[b]) - 5 and 5 * len(grams[b]) >= 4 * len(grams[a]) - 5 and similar(grams[a], grams[b], percent)]
    least = _least_reached(keys, links)
    return {i: (sum(k[0] == i for k in keys), [k[1] for k in keys if k[0] == i and least[k] != k]) for i, _ in docs}


def base_rules(text):
    """(words, their characters, symbols, repeated lines, words in repeated windows of five)."""
    t = text or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    spots: dict = {}
    for i in range(len(w) - 4):
        spots.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for s in spots.values() if len(s) > 1 for i in s for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def same_texts(docs):
    """doc_id: (smallest doc_id of the group, its size, sha256) of documents (doc_id, text)."""
    plain = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in docs}
    groups: dict = {}
    for i, t in plain.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain.items()}
