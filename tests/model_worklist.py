"""Graph simulation by a worklist in plain Python: the model that the engine is held against."""


def simulation(labels, edges, pattern_labels, pattern_edges, include_isolated=False):
    edges = {(a, b) for a, b in edges if a != b}
    touched = {x for e in edges for x in e}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    rel = {(q, v) for q, want in enumerate(pattern_labels) for v, have in labels.items() if have is not None and want in have and (include_isolated or v in touched)}
    while True:
        gone = {(q, v) for q, v in rel if any(s == q and not any((t, w) in rel for w in out.get(v, ())) for s, t in pattern_edges)}
        if not gone:
            break
        rel -= gone
    return rel if {q for q, _ in rel} == set(range(len(pattern_labels))) else set()
