"""Names after titles, and their mentions without one."""

import pytest

from stowlens.llm import pii


def found(text):
    return [(kind, text[a:b]) for kind, a, b, _ in pii.entities(text)]


@pytest.mark.parametrize("name", ["Dr Smith", "Prof. Smith", "Prof. Dr. Smith", "Dr John Smith", "Mr John Paul Smith", "Mr J. Smith", "Mr John van Smith"])
def test_no_part_of_a_titled_name_is_left(name):
    assert ("last", "Smith") in found(f"Then {name} went.")
    assert all(w not in name.split() or (k.startswith("first_")) == (w != "Smith") for k, w in found(f"Then {name} went."))


def test_words_that_may_have_an_apostrophe():
    assert found("Mr O'Brien met O’Brien and O'Brien's dog") == [("last", "O'Brien"), ("last", "O’Brien"), ("last", "O'Brien")]
    assert found("the doctor said so") == [] and found("smith is no name here, Dr Who?")[-1] == ("last", "Who")


def test_mentions_without_a_title_get_the_same_surrogates(spark):
    texts = ["John said: Mr John Paul Smith came. Later Smith, John Smith's dog and SMITH left; a smith did not.", "Dr Maria Weber, Frau Weber, Frau Maria Weber, Maria", "John Smith without a title", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace_entities(df, b"k").collect()}
    new = out[0].text
    assert not any(w in new for w in ("John", "Paul", "Smith", "SMITH")) and "a smith did not" in new and out[0].n_replaced == 8
    first, last = new.split(" ")[0], new.split("Later ")[1].split(",")[0]
    assert f"Mr {first} " in new and f"{first} {last}'s dog" in new and f"and {last.upper()} left" in new
    words = out[1].text.replace(",", "").split()
    assert words[1] == words[6] == words[8] and words[2] == words[4] == words[7] and words[1] != "Maria" and words[2] != "Weber"
    assert out[2].text == f"{first} {last} without a title" and out[3].text is None  # a known first name begins it
