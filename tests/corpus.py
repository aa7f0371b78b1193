"""A small corpus made of invented words, and a plain evaluator of queries over it."""

import math

from gleaner.functions.text import tokenize
from gleaner.plans.nodes import Not, Or, Phrase, Term, positive_tokens, prune
from gleaner.plans.parser import parse


def rows():
    """(doc_id, url, title, body) by family, each family with its own prefix."""
    out = [(3000 + i, "Title", "limit", "term term") for i in range(11)]
    out += [(1003, "Gamma", "rank", "search search engine"), (1002, "Beta", "rank", "engine search"), (1001, "Alpha", "rank", "search engine engine")]
    out += [(4003, "Gamma", "not", "cat dog bird"), (4002, "Beta", "not", "cat bird"), (4001, "Alpha", "not", "cat dog"), (2001, "Alpha", "miss", "search term")]
    out += [(5004, "Doc4", "or", "dog"), (5003, "Doc3", "or", "cat bird"), (5002, "Doc2", "or", "bird"), (5001, "Doc1", "or", "cat dog")]
    out += [(6003, "Doc3", "paren", "bird"), (6002, "Doc2", "paren", "dog bird"), (6001, "Doc1", "paren", "cat bird"), (8001, "Doc1", "neg", "cat")]
    out += [(7003, "", "phrase", "quick brown quick brown"), (7002, "", "phrase", "quick fox brown"), (7001, "", "phrase", "quick brown fox")]
    return [(i, f"https://corpus/{i}", title, " ".join(p + w for w in words.split())) for i, title, p, words in out]


class Evaluator:
    """Postings in dictionaries; scores by the written formulas."""

    def __init__(self, docs):
        self.positions, self.lengths = {}, {}
        for doc_id, _, title, body in docs:
            t, b = tokenize(title), tokenize(body)
            self.lengths[doc_id] = (len(t), len(b))
            for p, token in enumerate(t + b):
                self.positions.setdefault(token, {}).setdefault(doc_id, []).append(p)
        n = len(self.lengths)
        self.n = n
        self.averages = [sum(x[i] for x in self.lengths.values()) / n for i in (0, 1)]

    def idf(self, token):
        df = len(self.positions.get(token, {}))
        return math.log((self.n - df + 0.5) / (df + 0.5))

    def matches(self, node):
        """{doc_id: (ttf, [(token, positions)])}"""
        if isinstance(node, Term):
            return {d: (len(p), [(node.token, p)]) for d, p in self.positions.get(node.token, {}).items()}
        if isinstance(node, Phrase):
            out = {}
            for d in self.positions.get(node.tokens[0], {}):
                starts = [p for p in self.positions[node.tokens[0]][d] if all(p + i in self.positions.get(t, {}).get(d, ()) for i, t in enumerate(node.tokens))]
                if starts:
                    out[d] = (len(starts), [(t, [s + i for s in starts]) for i, t in enumerate(node.tokens)])
            return out
        if isinstance(node, Or):
            out = {}
            for c in node.children:
                for d, (f, m) in self.matches(c).items():
                    g, o = out.get(d, (0, []))
                    out[d] = (f + g, o + m)
            return out
        inside = [self.matches(c) for c in node.children if not isinstance(c, Not)]
        outside = [self.matches(c.child) for c in node.children if isinstance(c, Not)]
        keep = set.intersection(*map(set, inside)) - set().union(*outside)
        return {d: (sum(x[d][0] for x in inside), [m for x in inside for m in x[d][1]]) for d in keep}

    def score(self, doc, token, positions):
        lengths = self.lengths[doc]
        tf = [sum(p < lengths[0] for p in positions), sum(p >= lengths[0] for p in positions)]
        c = sum(w * (t / (0.25 + 0.75 * ln / a) if a else 0) for w, t, ln, a in zip((2.0, 1.0), tf, lengths, self.averages))
        return self.idf(token) * c * 2.2 / (c + 1.2) if c else 0.0

    def search(self, query, pruning=False):
        tree = parse(query)
        if pruning:
            known = set(positive_tokens(tree))
            tree = prune(tree, lambda t: t in known and self.idf(t) > 1.5)
            if tree is None:
                return {}
        return {d: (f, sum(self.score(d, t, p) for t, p in m)) for d, (f, m) in self.matches(tree).items()}


