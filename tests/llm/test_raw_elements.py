"""Elements whose content isn't text take no text of the page with them."""

import pytest

from tillsight.llm.extraction import blocks


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>one</p><svg class="i"/><p>two</p><p>three</p>', ["one", "two", "three"]),
        ('<p>one</p><object data="x"><p>two</p>', ["one", "two"]),
        ('<p>one</p><object data="x"><p>two</p><object>gone</object><p>three</p>', ["one", "two", "three"]),
        ("<p>one</p><video-player></video-player><p>two</p><video>gone</video><p>three</p>", ["one", "two", "three"]),
        ("<button-group><p>one</p></button-group><button>gone</button><p>two</p>", ["one", "two"]),
        ("<svg><svg>gone</svg>gone</svg><p>one</p>", ["one"]),
        ("<svg><title/><path/></svg><p>one</p>", ["one"]),
        ("<p>one</p><svg>gone<script>'</svg>'</script>gone</svg><p>two</p>", ["one", "two"]),
        ("<p>one</p><script>a < b</SCRIPT ><p>two</p><style>open", ["one", "two"]),
    ],
)
def test_text_around_raw_elements_stays(page, want):
    assert [b[1] for b in blocks(page)] == want
