"""Small awkward tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the on er an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(rnd: random.Random, words: int) -> str:
    out = ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(words)]
    return " ".join(w.capitalize() + "." if rnd.random() < 0.1 else w for w in out)


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and blank texts, odd characters, a long text."""
    rnd = random.Random(seed)
    texts: list[str | None] = [prose(rnd, rnd.randint(1, 200)) for _ in range(n)]
    passage = prose(rnd, 60)
    for i in range(0, n, 7):
        texts[i] = f"{texts[i]} {passage} {prose(rnd, 5)}"
    for i in range(1, n, 9):
        texts[i] = texts[i - 1]
    for i in range(2, n, 11):
        words = (texts[i - 2] or "").split(" ")
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    texts += [None, None, "", "   \n\t ", "a", "a", " a\n", "é" * 300, "Ünïcödé ẞ ß 日本語 \U0001f600 <|endoftext|> it's", "a" * 2000,
              "ab" * 900, "x y " * 400, prose(rnd, 3000), "tab\tnew\nline\r\n  two  spaces", "nul\0in\0text " * 20]
    return [(i, t, None if i % 5 == 0 else "en", "hot" if i % 3 else None, None) for i, t in enumerate(texts)]
