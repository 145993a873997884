import random

import pytest

NOUNS = ["나무", "바다", "하늘", "도시", "학교", "시장", "공원", "도서관", "병원", "회사", "강물", "기차", "신문", "노래", "그림", "사진", "편지", "연필", "겨울", "여름"]
VERBS = ["보았다", "만들었다", "찾았다", "고쳤다", "떠났다", "지켰다", "옮겼다", "세웠다"]


def sentence(rng: random.Random) -> str:
    return f"{rng.choice(NOUNS)}{rng.choice(NOUNS)}에서 {rng.choice(NOUNS)}{rng.randrange(10**5)}호가 {rng.choice(NOUNS)}{rng.choice(NOUNS)}를 {rng.randrange(10**4)}번 {rng.choice(VERBS)}."


def text(rng: random.Random, n: int = 10) -> str:
    return " ".join(sentence(rng) for _ in range(n))


def edited(rng: random.Random, t: str, share: float = 0.1) -> str:
    words = t.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = rng.choice(NOUNS) + str(rng.randrange(1000))
    return " ".join(words)


@pytest.fixture
def rng():
    return random.Random(5)
