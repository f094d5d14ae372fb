"""Omnitigs and macro structures by their definitions, on lists of arcs: what the operators' tables are compared with."""

from __future__ import annotations

class Digraph:
    """Edges are numbered; a walk is a tuple of edge numbers."""

    def __init__(self, arcs: list[tuple]):
        self.arcs = arcs
        self.out: dict = {}
        self.into: dict = {}
        for i, (a, b) in enumerate(arcs):
            self.out.setdefault(a, []).append(i)
            self.out.setdefault(b, [])
            self.into.setdefault(b, []).append(i)
            self.into.setdefault(a, [])

    def detour(self, source, target, not_first: int, not_last: int) -> bool:
        """Whether a simple path leads from source to target (a circle where they are one node) without not_first as first and not_last as last edge."""
        firsts = [e for e in self.out[source] if e != not_first]
        lasts = {self.arcs[e][0] for e in self.into[target] if e != not_last}
        if any(self.arcs[e][1] == target and e != not_last for e in firsts):
            return True
        seen = {self.arcs[e][1] for e in firsts} - {source, target}
        todo = list(seen)
        while todo:
            v = todo.pop()
            if v in lasts:
                return True
            for e in self.out[v]:
                w = self.arcs[e][1]
                if w not in seen and w != source and w != target:
                    seen.add(w)
                    todo.append(w)
        return False

    def extends(self, walk: tuple, edge: int) -> bool:
        """Whether the omnitig walk stays one with edge behind: only what ends before the new edge is tested."""
        v = self.arcs[edge][0]
        for i in range(1, len(walk) + 1):
            u = self.arcs[walk[i - 1]][1]
            if self.detour(v, u, edge, walk[i - 1]):
                return False
        return True


def is_part(a: tuple, b: tuple) -> bool:
    return len(a) <= len(b) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))


def maximal(walks: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for w in sorted(set(walks), key=lambda w: (-len(w), w)):
        if not any(is_part(w, x) for x in out):
            out.append(w)
    return sorted(out)


def maximal_omnitigs(arcs: list[tuple]) -> list[tuple]:
    """Of a strongly connected graph, as walks of edge numbers. Omnitigs are closed under subwalks, so they are grown edge by edge. A graph that is one circle has its once-around walk from edge 0."""
    g = Digraph(arcs)
    if not arcs:
        return []
    if all(len(x) == 1 for x in g.out.values()) and all(len(x) == 1 for x in g.into.values()):
        walk = [0]
        while (e := g.out[arcs[walk[-1]][1]][0]) != 0:
            walk.append(e)
        return [tuple(walk)]
    most = 4 * len(arcs)
    front, done = [(e,) for e in range(len(arcs))], []
    while front:
        nxt = []
        for w in front:
            grown = [w + (e,) for e in g.out[arcs[w[-1]][1]] if g.extends(w, e)] if len(w) < most else []
            nxt += grown
            if not grown:
                done.append(w)
        front = nxt
    return maximal(done)


def is_trivial(g: Digraph, walk: tuple) -> bool:
    """Whether the walk is the univocal extension of an edge: no join before a split inside it."""
    joins = [i for i in range(1, len(walk)) if len(g.into[g.arcs[walk[i]][0]]) > 1]
    splits = [i for i in range(1, len(walk)) if len(g.out[g.arcs[walk[i]][0]]) > 1]
    return not joins or not splits or max(splits) <= min(joins)


def macronodes(arcs: list[tuple]) -> dict:
    """Nodes by the bivalent node (several edges in and out) at their centre: those that reach it while they have one edge out, and those it reaches while they have one edge in."""
    g = Digraph(arcs)
    found = {}
    for v in g.out:
        if len(g.out[v]) > 1 and len(g.into[v]) > 1:
            own, todo = {v}, [(v, 0), (v, 1)]
            while todo:
                u, ahead = todo.pop()
                for e in g.out[u] if ahead else g.into[u]:
                    w = arcs[e][1] if ahead else arcs[e][0]
                    if w not in own and len(g.into[w] if ahead else g.out[w]) == 1:
                        own.add(w)
                        todo.append((w, ahead))
            found[v] = own
    return found


def microtigs(arcs: list[tuple], walks: list[tuple]) -> dict:
    """Per macronode, the longest pieces of non-trivial omnitigs inside it."""
    g = Digraph(arcs)
    hard = [w for w in walks if not is_trivial(g, w)]
    out = {}
    for centre, own in macronodes(arcs).items():
        pieces = []
        for w in hard:
            start = None
            for i in range(len(w) + 1):
                inside = i < len(w) and (arcs[w[i]][0] in own or arcs[w[i]][1] in own)
                if inside and start is None:
                    start = i
                if not inside and start is not None:
                    if i - start > 1:
                        pieces.append(w[start:i])
                    start = None
        out[centre] = maximal(pieces)
    return out


def macrotigs(pieces: dict) -> list[tuple]:
    """Microtigs joined where one ends with the edge that the next starts with, while there is no choice."""
    parts = [w for own in pieces.values() for w in own]
    starts: dict = {}
    ends: dict = {}
    for w in parts:
        starts.setdefault(w[0], []).append(w)
        ends.setdefault(w[-1], []).append(w)
    linked = lambda w: len(starts.get(w[-1], [])) == 1 and len(ends[w[-1]]) == 1
    heads = [w for w in parts if not (len(ends.get(w[0], [])) == 1 and len(starts[w[0]]) == 1)]
    out, used = [], set()
    for w in heads + sorted(parts):  # what no head leads to runs in circles
        if w in used:
            continue
        walk, last = w, w
        used.add(w)
        while linked(last) and (nxt := starts[last[-1]][0]) not in used:
            walk += nxt[1:]
            used.add(nxt)
            last = nxt
        out.append(walk)
    return maximal(out)


def node_safe_walks(arcs: list[tuple]) -> list[tuple]:
    """Maximal node walks that are in every node-covering circular walk: of a strong graph the node sequences of omnitigs without the ends that some covering walk avoids."""
    walks = []
    for w in maximal_omnitigs(arcs):
        nodes = [arcs[w[0]][0]] + [arcs[e][1] for e in w]
        g = Digraph(arcs)
        a, b = 0, len(nodes)
        while b - a > 1 and len(g.into[nodes[a + 1]]) > 1 and len(g.out[nodes[a]]) > 1:
            a += 1
        while b - a > 1 and len(g.out[nodes[b - 2]]) > 1 and len(g.into[nodes[b - 1]]) > 1:
            b -= 1
        walks.append(tuple(nodes[a:b]))
    return maximal(walks)


