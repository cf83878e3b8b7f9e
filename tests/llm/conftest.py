import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, sig string, spans string, topic_extra int"

_VOWELS = {"en": ["the", "ing", "th", "er", "and", "ou", "sh"], "de": ["ein", "sch", "keit", "ü", "ber", "ich", "ö"], "fr": ["eau", "è", "ment", "ou", "ré", "tion", "que"]}


def sentence(rng, lang, n):
    parts = _VOWELS[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    """Invented texts with nulls, empty and long ones, ties, copies, near copies and repeated rows."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        rows.append((k, sentence(rng, lang, rng.randint(3, 90)), lang, f"src{k % 4}"))
    base = sentence(rng, "en", 120)
    rows += [(100 + k, base, "en", "hot") for k in range(5)]
    for k in range(12):
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((200 + k, " ".join(words), "en", "hot"))
    rows += [
        (300, None, "en", "src0"), (301, "", None, None), (302, "   \n\t ", "de", "src1"), (303, "one two", "en", "src1"), (304, "One  TWO", "en", "src1"), (305, "1234 5678 !!", None, "src2"),
        (306, sentence(rng, "de", 6000), "de", "src2"), (307, "x" * 30000, "en", "src2"), (None, sentence(rng, "fr", 30), "fr", "src3"), (5, rows[5][1], "fr", "src1"),
        (308, "Mail a.b+c@mail.example.com or x@y then 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111, tel +1 (523) 555-1055. é@é.com 😀 4111111111111112", "en", "src3"),
        (309, "a@b.cc_x@d.ee 1.2.3.4.5.6.7.8 +12345678901234567 call (523) 555-1055 or write jo [at] mail [dot] com", "en", "src3"),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(*r, len(r[1] or ""), "clash", "clash", "clash", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
