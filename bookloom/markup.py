"""The standard tokeniser of HTML, without its refusals."""

from __future__ import annotations

from html.parser import HTMLParser


class Tokeniser(HTMLParser):
    """As a browser does, takes a declaration it can't read for a comment up to the next ``>``."""

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section with an unknown keyword or none
            return self.parse_bogus_comment(i)
