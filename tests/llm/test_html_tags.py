"""Ends of tags and of the head."""

from vespera.llm.html_text import blocks


def text(page):
    return "\n".join(t for t, side, _ in blocks(page) if not side)


def test_quoted_values_end_where_their_quote_does():
    assert text("""<p title="it's">Don't panic</p><p>it's > all</p>""") == "Don't panic\nit's > all"
    assert text(f"<p data-html='{'<b>x</b>' * 30}' onclick = \"a>b\">seen</p>") == "seen"
    assert text("""<p title="open>seen</p>""") == "seen"
    assert text("<p title='x'class=\"a>\">seen <a href=it's>too</a></p>") == "seen too"


def test_a_head_without_end_tag_ends_at_the_body_or_first_block():
    assert text("<html><head><title>t</title><meta charset=utf-8><body><p>seen</p>") == "seen"
    assert text("<head><title>t</title><style>p>b</style><p>seen</p>more") == "seen\nmore"
    assert text("<head><title>t</title></head><body>seen</body>") == "seen"


def test_broken_quotes_take_linear_time():
    assert text("<a b='>x" * 50_000)
