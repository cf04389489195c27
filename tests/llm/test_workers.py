import pytest

from chronolith.llm import spm
from chronolith.llm.queries import MODEL, _tokenizer
from chronolith.llm.workers import lean


@pytest.mark.parametrize("together", [1, 2, 7])
def test_tables_of_any_size_give_the_same_cuts(monkeypatch, together):
    pieces = spm.load(_tokenizer(MODEL))
    texts = ["one two three four two one", "ein längeres Wort: Donaudampfschifffahrt", "日本語 ▁ \x00 " + "x" * 100, "", None, "\n\n a\n"]
    whole = spm.encode(pieces, texts)
    monkeypatch.setattr(spm, "TOGETHER", together)
    assert spm.encode(pieces, texts) == whole


def test_lean_passes_results_and_errors_on():
    assert list(lean(lambda rows: (2 * r for r in rows))([1, 2, 3])) == [2, 4, 6]
    with pytest.raises(ZeroDivisionError):
        list(lean(lambda rows: (1 // r for r in rows))([1, 0]))
