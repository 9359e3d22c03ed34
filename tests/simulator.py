"""A second, plain version of the graph algorithms, one node at a time in Python, to hold the plans against.

Written from the definitions: wiring pairs the two ordered sides greedily; messages are applied one after the other;
walks recurse.
"""

from collections import Counter


def kmer_counts(seqs, k):
    return Counter(s[i : i + k] for s in seqs for i in range(len(s) - k + 1))


class Graph:
    """node -> {'P': [ext], 'S': [ext]}; ext is a list [text, terminal, cnt, visit]. Digits throughout."""

    def __init__(self, kmers, k, coverage):
        self.k, self.nodes = k, {}
        for kmer, cnt in sorted(kmers.items()):
            visit = -(-cnt // coverage)
            self._side(kmer[:-1], "S").append([kmer[-1], False, cnt, visit])
            self._side(kmer[1:], "P").append([kmer[0], False, cnt, visit])
        for sides in self.nodes.values():
            p, s = (sum(e[3] for e in sides[x]) for x in "PS")
            sides["P"].append(["", True, 1, max(s - p, 0)])
            sides["S"].append(["", True, 1, max(p - s, 0)])

    def _side(self, node, side):
        return self.nodes.setdefault(node, {"P": [], "S": []})[side]

    def wires(self, node):
        """[(prefix, suffix, offset in prefix, offset in suffix, count)]"""
        order = lambda side: sorted((e for e in self.nodes[node][side] if e[3]), key=lambda e: (-e[3], -e[2], e[1], len(e[0]), e[0]))
        out, p, s = [], [[e, 0] for e in order("P")], [[e, 0] for e in order("S")]
        while p and s:
            (pe, pu), (se, su) = p[0], s[0]
            n = min(pe[3] - pu, se[3] - su)
            out.append((pe, se, pu, su, n))
            p[0][1] += n
            s[0][1] += n
            if p[0][1] == pe[3]:
                p.pop(0)
            if s[0][1] == se[3]:
                s.pop(0)
        return out

    def neighbor(self, node, side, ext):
        whole = ext + node if side == "P" else node + ext
        n = self.k - 1
        return (whole[:n], whole[n:]) if side == "P" else (whole[-n:], whole[:-n])

    def independent(self):
        chosen = []
        for node, sides in self.nodes.items():
            near = [self.neighbor(node, side, e[0])[0] for side in "PS" for e in sides[side] if not e[1]]
            if all(x <= node for x in near):
                chosen.append(node)
        return chosen

    def round(self):
        """One round; (nodes before, chosen, messages, partial contigs)."""
        before, chosen, messages, contigs = len(self.nodes), self.independent(), [], []
        for node in chosen:
            for p, s, _, _, n in self.wires(node):
                if p[1] and s[1]:
                    contigs.append(p[0] + node + s[0])
                    continue
                pk, pb = self.neighbor(node, "P", p[0])
                sk, sb = self.neighbor(node, "S", s[0])
                p_self, s_self = not p[1] and pk == node, not s[1] and sk == node
                if not p[1] and not p_self:
                    messages.append((pk, "S", pb, pb + s[0], min(p[2], s[2]), n, s[1] or s_self))
                if not s[1] and not s_self:
                    messages.append((sk, "P", sb, p[0] + sb, min(p[2], s[2]), n, p[1] or p_self))
        for node in chosen:
            del self.nodes[node]
        for node, side, old, new, cnt, visit, terminal in messages:
            rows = self.nodes[node][side]
            hit = next((e for e in rows if e[0] == old and not e[1]), None)
            if hit:
                hit[:] = [new, terminal, cnt, visit]
                hit.append("new")
            else:
                rows.append([new, terminal, cnt, visit])
        for sides in self.nodes.values():
            for side in "PS":
                for e in sides[side]:
                    del e[4:]
        return before, len(chosen), len(messages), contigs

    def walks(self, mode="reference"):
        out = []

        def go(node, prefix, off, freq, contig):
            for p, s, start, s_off, size in self.wires(node):
                if p is not prefix:
                    continue
                if mode == "full":
                    taken = start + size > off and start < off + freq
                else:
                    taken = start + size > off and (start <= off or 2 * (start - off) <= freq)
                if not taken:
                    continue
                at = max(off, start)
                n = min(off + freq, start + size) - at
                if s[1]:
                    out.append(contig + s[0])
                    continue
                key, back = self.neighbor(node, "S", s[0])
                rows = sorted((e for e in self.nodes[key]["P"] if e[0] == back), key=lambda e: (e[1], -e[3], -e[2]))
                go(key, rows[0], s_off + at - start, n, contig + s[0])

        for node, sides in self.nodes.items():
            for p in sides["P"]:
                if p[1] and p[3]:
                    go(node, p, 0, p[3], p[0] + node)
        return out
