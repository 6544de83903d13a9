import random

import pytest


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators must survive: null, empty, blank, very long, one long word, odd characters."""
    rng = random.Random(4)
    stock = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [None, "", " \t\n\x0b\x0c\r ", words(rng, 60_000, stock), "x" * 200_000, "Ünïcode ß İ Σας 日本語 🙂👍🏽   \x1c", "a", "a b c", "A\nb\n\nc\n"]


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared lines and shared passages."""
    rng = random.Random(9)
    stock = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    passage, line = words(rng, 60, stock), words(rng, 8, stock)
    texts = []
    for _ in range(60):
        texts.append("\n".join(words(rng, rng.randint(5, 40), stock) for _ in range(rng.randint(1, 5))))
    for base in texts[:6]:
        texts += [base, base.upper()]
    for base in texts[6:16]:
        for _ in range(4):
            own = base.split(" ")
            for _ in range(max(1, len(own) // 40)):
                own[rng.randrange(len(own))] = rng.choice(stock)
            texts.append(" ".join(own))
    texts += [f"{words(rng, 6, stock)} {passage} {words(rng, 4, stock)}" for _ in range(30)]
    texts += [f"{words(rng, 12, stock)}\n  {line.upper()} \n{words(rng, 3, stock)}" for _ in range(12)]
    return [(k * 3, t, f"src{k % 4}" if k % 11 else None, "en") for k, t in enumerate(texts)]
