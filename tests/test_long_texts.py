"""Long texts of one pattern: nothing may take more than about linear time."""

import time

import pytest

from folioflow.operators.convert import convert_text
from folioflow.operators.scan import spans
from folioflow.sources.html import html_to_markdown

N = 120_000
LONG = {
    "letters": "a" * N, "digits": "1" * N, "blanks": "# x" + " " * N + "y", "dots": "." * N + "a", "open": "[" * N, "openclose": "[" * N + "]", "tags": "<a " * (N // 3), "half links": "[a](" * (N // 4),
    "pipes": "| a " * (N // 4), "marks": "!" * N + "a", "dashes": "1-" * (N // 2), "zero width": "​" * N, "comments": "<!--" * (N // 4) + ">", "quotes": "> " * (N // 2), "lines": "\n" * N,
}


@pytest.mark.parametrize("name", LONG)
def test_long(name):
    for fn in (convert_text, html_to_markdown, lambda t: list(spans(t))):
        t = time.perf_counter()
        fn(LONG[name])
        assert time.perf_counter() - t < 10
