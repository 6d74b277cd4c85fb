"""Token ids of texts with very long white space equal those of ``tokenizers``."""

import pytest

from webmine.llm import packing

TOKEN = "<|endoftext|>"


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, pattern, added = packing.default_vocabulary()
    return packing.byte_bpe(path, pattern, added), added, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def same(both, text):
    bpe, added, reference = both
    assert packing.token_ids(bpe, text, added) == reference.encode(text, add_special_tokens=False).ids


def test_a_million_spaces(both):
    same(both, " " * 1_000_000)


@pytest.mark.parametrize("space", [" ", "\n", " \t", "　", "\xa0 ", " \n\n"])
def test_runs_between_words(both, space, monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 40)
    run = space * 60
    for text in (run, f"a{run}", f"{run}a", f"a{run}b", f"a {run}'s{run}1{run}", f"a.{run}{TOKEN}{run}b", f"{TOKEN}{run}{TOKEN}", f"x{run}é{' ' * 30}y{run}\x1c{run}z"):
        same(both, text)


def test_long_run_with_text_around(both):
    same(both, "one two" + " " * 300_000 + "three" + "\n" * 200_000 + TOKEN + " " * 150_000)
