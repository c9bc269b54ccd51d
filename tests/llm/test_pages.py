"""Wrappers of the content whose attributes look like those of other elements."""

import pytest

from logjury.llm import pages

BODY = "<p>" + "one two three four five " * 8 + "</p><p>" + "six seven eight nine " * 8 + "</p>"
WANT = ("one two three four five " * 8).strip() + "\n\n" + ("six seven eight nine " * 8).strip()


@pytest.mark.parametrize(
    "rest",
    ['class="overflow-hidden"', 'style="overflow:hidden"', 'title="hidden gems"', 'class="with-sidebar"',
     'class="no-sidebar"', 'class="post comment-open"', "class=social", "id=search", 'class="notice"'],
)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_wrappers_are_kept(rest, inner):
    side = "<div class=sidebar><p>side words</p></div>"
    for tag in ("div", "article", "section"):
        page = f"<body><h6>x</h6><{tag} {rest}>{inner.format(BODY)}{side}</{tag}>" + "<i></i>" * 30 + "<p>end</p></body>"
        assert WANT in pages.main_text(page, pages.Weights({})), (tag, page)
        assert "side words" not in pages.main_text(page, pages.Weights({})), (tag, page)


def test_marked_elements_around_stay_out():
    page = f"<body><p hidden>no</p><div style='display: none'>no</div><article>{BODY}</article><div class=comments>no</div>"
    assert pages.main_text(page, pages.Weights({})) == WANT
    several = "".join(f"<div class=social><article>{BODY}</article></div>" for _ in range(3))
    assert pages.main_text(several, pages.Weights({})) == "\n\n".join([WANT] * 3)
