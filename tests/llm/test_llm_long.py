"""Long texts of one pattern: nothing may take more than about linear time."""

import time

import pytest

pytest.importorskip("folioflow.llm.queries")

from folioflow.llm import language, leakage, personal_data, splitting, text_quality, visible_form

N = 120_000
LONG = {
    "letters": "a" * N, "capitals": "A" * N, "digits": "1" * N, "dots": "." * N + "a", "ellipses": "…" * N + "a", "semicolons": ";" * N + "a", "spaced dots": ". " * (N // 2) + "a", "dashes": "1-" * (N // 2),
    "marks": "á" * (N // 2), "zero width": "​" * N, "at": "a@" * (N // 2), "names": "Mr Holz van Fenn, " * (N // 18), "spelled": "one " * (N // 4), "blanks": " " * N, "lines": "\n" * N, "tags": "<a " * (N // 3),
}


@pytest.mark.parametrize("name", LONG)
def test_long(name):
    t = visible_form.Transducer()
    for fn in (
        lambda s: text_quality.finish(text_quality.partial(s)), language.sentences, leakage.words, lambda s: personal_data.find_values(s, t), lambda s: splitting.split_text(s, 500, 20), t.apply,
    ):
        at = time.perf_counter()
        fn(LONG[name])
        assert time.perf_counter() - at < 10
