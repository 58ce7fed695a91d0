"""Strong, strict and bounded simulation in plain Python: the models that the engine is held against."""


def dual(labels, edges, wants, pattern_edges, start=None):
    rel = {(q, v) for q, want in enumerate(wants) for v, have in labels.items() if have is not None and want in have} if start is None else set(start)
    while True:
        gone = set()
        for q, v in rel:
            down = all(any((t, w) in rel for a, w in edges if a == v) for s, t in pattern_edges if s == q)
            up = all(any((s, w) in rel for w, b in edges if b == v) for s, t in pattern_edges if t == q)
            if not (down and up):
                gone.add((q, v))
        if not gone:
            return rel
        rel -= gone


def _distances(near, start, most):
    seen, front = {start: 0}, [start]
    for hop in range(most):
        front = [w for v in front for w in near.get(v, ()) if w not in seen and not seen.update({w: hop + 1})]
    return set(seen)


def _near(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def strong(labels, edges, wants, pattern_edges, strict=False):
    edges = {(a, b) for a, b in edges if a != b}
    near_q = _near(pattern_edges)
    radius = max(min(k for k in range(len(wants) + 1) if t in _distances(near_q, s, k)) for s in range(len(wants)) for t in range(len(wants)))
    whole = dual(labels, edges, wants, pattern_edges)
    if {q for q, _ in whole} != set(range(len(wants))):
        return set()
    touched = {x for e in edges for x in e}
    whole = {(q, v) for q, v in whole if v in touched}
    held = {(a, b) for a, b in edges if any((s, a) in whole and (t, b) in whole for s, t in pattern_edges)} if strict else edges
    near, out = _near(held), set()
    for centre in labels:
        if not any(v == centre for _, v in whole):
            continue
        ball = _distances(near, centre, radius)
        inside = {(a, b) for a, b in held if a in ball and b in ball}
        rel = dual(labels, inside, wants, pattern_edges, {(q, v) for q, v in (whole if strict else dual(labels, edges, wants, pattern_edges)) if v in ball and v in touched})
        if {q for q, _ in rel} != set(range(len(wants))):
            continue
        match = _near({(a, b) for a, b in inside if any((s, a) in rel and (t, b) in rel for s, t in pattern_edges)})
        if any(v == centre for _, v in rel):
            part = _distances(match, centre, len(labels))
            out |= {(centre, q, v) for q, v in rel if v in part}
    return out


def bounded(labels, edges, wants, pattern_edges, bounds):
    edges = {(a, b) for a, b in edges if a != b}
    touched = {x for e in edges for x in e}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def within(v, k):
        found, front = set(), {v}
        for _ in range(len(labels) + 1 if k is None else k):
            front = {w for x in front for w in out.get(x, ())}
            if front <= found:
                break
            found |= front
        return found

    reach = {(v, k): within(v, k) for v in labels for k in set(bounds)}
    rel = {(q, v) for q, want in enumerate(wants) for v, have in labels.items() if have is not None and want in have and v in touched}
    while True:
        gone = {(q, v) for q, v in rel if any(s == q and not any((t, w) in rel for w in reach[v, k]) for (s, t), k in zip(pattern_edges, bounds))}
        if not gone:
            break
        rel -= gone
    return rel if {q for q, _ in rel} == set(range(len(wants))) else set()
