"""What a worker holds while it encodes is bounded: the library gets few texts at a time, and the ids stay the same."""

from folio.llm import tokens


class Watched:
    """A tokenizer that notes how much text each call brings."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def encode_batch_fast(self, texts, **kw):
        self.seen.append(sum(map(len, texts)))
        return self.inner.encode_batch_fast(texts, **kw)


def test_library_gets_few_texts_at_a_time():
    letters = "abcdefghij"
    word = lambda i: "".join(letters[int(c)] for c in str(i))
    plain = " ".join(f"{word(i)}xyz" for i in range(100_000, 180_000))
    other = " ".join(f"{i}-É{word(i)}" for i in range(100_000, 140_000))
    w, seen = tokens.WordEncoder(tokens.default_path()), []
    full = w.full
    w.plain, w.full = Watched(w.plain, seen), Watched(w.full, seen)
    got = [x.tolist() for x in w.ids([plain.encode(), other.encode(), b""])]
    assert got == [full.encode(t, add_special_tokens=False).ids for t in (plain, other, "")]
    assert len(seen) > 3 and max(seen) < len(plain) / 2
