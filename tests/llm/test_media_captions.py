import pytest

from accessum.llm import media


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<figure><figcaption>Cap</figcaption><img src=a alt=x><img src=b></figure>After", [("a", "Cap"), ("b", "Cap"), ("After", None)]),
        ("<p>One<figure><figcaption>Cap</figcaption></figure>Two", [("One", None), ("Cap", None), ("Two", None)]),
        ("<figure><img src=a><figcaption>Cap</figure><p>Two", [("a", "Cap"), ("Two", None)]),
        ("<html><head><title>no</title><body><p>Text", [("Text", None)]),
        ("<head><title>no</title><p>Text</p>", [("Text", None)]),
        ("<img srcset='a.png 1x, b.png 2x' alt=x>", [("a.png", "x")]),
    ],
)
def test_nothing_is_swallowed(page, want):
    assert [(x["text"] or x["src"], x["caption"]) for x in media.parse_page(page)] == want
