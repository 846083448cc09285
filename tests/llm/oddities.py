"""Input that every operator must take."""

#: Null and empty texts, blanks only, ties and repeated rows, a null id, white space and letters outside ASCII, a long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"), (6, "a b c d İ ΣΣ. W̊"),
    (7, "\n\n\nA line\na LINE \n\tA line"), (8, "word " * 30_000), (9, "<|endoftext|> x<|startoftext|>y"), (10, "café café, CAFÉ \\### Assistant: </turn>"),
]


def thue_morse(n, letters="ab"):
    """A word of n letters and the one with its letters swapped: polynomial hashes modulo 2^64 can't tell them apart."""
    first = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return first, first.translate(str.maketrans(letters, letters[::-1]))


class PlainTrie:
    """Prediction by partial matching as the definition has it: method D, exclusion, every count at all orders."""

    def __init__(self, order):
        self.order, self.n = order, {}

    def learn(self, text):
        symbols = [*text.lower(), 256]
        for at, x in enumerate(symbols):
            for k in range(min(self.order, at) + 1):
                context = tuple(symbols[at - k : at])
                self.n[context, x] = self.n.get((context, x), 0) + 1
                self.n.setdefault(context, set()).add(x)

    def score(self, text):
        import math

        symbols, total = [*text.lower(), 256], 0.0
        for at, x in enumerate(symbols):
            p, out = 1.0, set()
            for k in range(min(self.order, at), -1, -1):
                context = tuple(symbols[at - k : at])
                seen = self.n.get(context, set())
                if not seen:
                    continue
                escape = len(seen) % 257
                whole = escape + sum(2 * self.n[context, y] - 1 for y in seen - out)
                if x in seen:
                    p *= (2 * self.n[context, x] - 1) / whole
                    break
                p, out = p * escape / whole, out | seen
            else:
                p /= 257 - len(out)
            total += math.log10(p)
        return total
