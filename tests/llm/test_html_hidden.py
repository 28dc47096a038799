import pytest

from tessera.llm.html import blocks


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>one <svg width='1'/> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <math/> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <svg><title>t</title><g><path d='M0'/><text>no</text></g></svg> two</p>", ["one two"]),
        ("<p>one</p><svg><path d='M0'><p>two</p><p>three</p>", ["one", "two", "three"]),
        ("<svg><style/><foreignObject><p>no</p></foreignObject></svg><p>one</p>", ["one"]),
        ("<div><video src=x></div><p>one</p>", ["one"]),
        ("<p>one<canvas><p>two</p>", ["one", "two"]),
        ("<div>one<object><p>no</p></object> two<select><option>no<option>no</select></div><p>three</p>", ["one two", "three"]),
        ("<div>one<select><option>no</div><p>two</p>", ["one", "two"]),
        ("<video><video>no</video>no</video><p>one <a>two</a></p>", ["one two"]),
        ("<template><div>no</div></template><p>one<audio>no<br></audio></p>", ["one"]),
        ("<p>one <select><option>no<option>no</select> two</p>", ["one two"]),
        ("<p>a<textarea><p>no</textarea>b", ["ab"]),
    ],
)
def test_text_around_hidden_elements_stays(page, texts):
    assert [b.text for b in blocks(page)] == texts


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>one <textarea>two</p><p>three</p>", ["one two", "three"]),
        ("<p>one</p><iframe src=x><p>two</p>", ["one", "two"]),
        ("<title>name<p>one</p>", ["name", "one"]),
        ("<p>one</p><title>name</title><iframe>no</iframe><p>two</p>", ["one", "two"]),
        ("<p>one</p><script>no <p>no</p>", ["one"]),
        ("<p>one</p><style>no", ["one"]),
        ("<p>one</p><!-- no <p>no</p> no", ["one"]),
        ("<p>one</p>two <b", ["one", "two <b"]),
    ],
)
def test_elements_without_an_end(page, texts):
    assert [b.text for b in blocks(page)] == texts


@pytest.mark.parametrize("part", ['<a "', "<a '", "<textarea>", "<iframe><b ", "<!-", "<p", "<!--", "</", "<svg><a ", '<a b="c>', "<div>", "<div></b>", "<li>"])
def test_time_is_linear(part):
    import time

    start = time.process_time()
    blocks(part * (500_000 // len(part)))
    assert time.process_time() - start < 5
