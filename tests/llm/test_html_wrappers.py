"""Main text of pages inside forms, blocks with odd names, and comments and footers without containers."""

import pytest

from tidesignal.llm.html import main_text

CASES = {
    "page in a server's form": ('<body><form id="aspnetForm"><input type=hidden name=v><nav><a href=/>Home</a> <a href=/b>Us</a></nav><div><h1>The title</h1><p>Some words stand here and stay.</p></div><div class="footer">Imprint</div></form></body>', "The title\n\nSome words stand here and stay."),
    "form in main": ("<main><form><p>Some words stand here.</p></form></main>", "Some words stand here."),
    "search field in the form around": ('<form><div class="search"><input></div><article><h1>T</h1><p>One two three four five six seven eight nine ten.</p></article></form>', "T\n\nOne two three four five six seven eight nine ten."),
    "forms that ask": ("<body><p>Only words of the page that stand in it.</p><form><label>Name of you and your family please</label><input><p>Sign up here</p></form></body>", "Only words of the page that stand in it."),
    "nothing but a form that asks": ("<form><label>User</label><input><label>Pass</label><input type=password><button>Go</button><p>Log in now</p></form>", ""),
    "names that hold a hint": ('<article><h1>T</h1><p class="share-price">The share price rose.</p><div class="menu-of-the-day"><p>Soup and bread.</p></div><p>End.</p></article>', "T\n\nThe share price rose.\n\nSoup and bread.\n\nEnd."),
    "hints as whole words": ('<article><h1>T</h1><p class="ad">Buy now.</p><div class="share-buttons"><p>Tell all.</p></div><p>End of it.</p></article>', "T\n\nEnd of it."),
    "comments after a heading": ("<body><h1>Title of it</h1><p>The text of the page is this one here.</p><h3>Comments</h3><div><p>I like it much.</p></div><p>Me too.</p></body>", "Title of it\n\nThe text of the page is this one here."),
    "comments end at a heading as high": ("<body><article><h1>Title of it</h1><p>The text of the page is this one here.</p><h3>3 Comments</h3><p>I like it much.</p><h2>More text</h2><p>Goes on.</p></article></body>", "Title of it\n\nThe text of the page is this one here.\n\nMore text\n\nGoes on."),
    "an article on comments": ("<article><h1>Comments</h1><p>Comments on the net are old.</p><h2>Comments on old books</h2><p>They are older.</p></article>", "Comments\n\nComments on the net are old.\n\nComments on old books\n\nThey are older."),
    "a footer without a container": ("<body><article><h1>Title of it</h1><p>The text is here.</p><p>&copy; 2024 Site of all</p></article></body>", "Title of it\n\nThe text is here."),
    "rights in the midst": ("<article><p>Copyright 1920. All rights reserved. So it says.</p><p>The text is here.</p></article>", "Copyright 1920. All rights reserved. So it says.\n\nThe text is here."),
    "headings left open": ("<body><h1>Title<p>Words of it.</p><h3>Comments<div>Mine.</div></body>", "Title\n\nWords of it.\n\nComments\n\nMine."),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert main_text(page) == want
