import pytest

from foliospark.functions import text as T


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (T.remove_image_lines, "Pumps\n\n<!-- Image -->\n\n\n[image]\n\nValves", "Pumps\n\nValves"),
        (T.remove_html_comments, "x <!-- one -->y<!-- two --> z", "x y z"),
        (T.remove_html_comments, "a <!-- over\ntwo --> b", "a <!-- over\ntwo --> b"),
        (T.space_markdown_headers, "#Pumps\ntext #no\n###### Deep", "# Pumps\ntext #no\n###### Deep"),
        (T.rejoin_wrapped_lines, "a pump moves\nwater uphill\n\n* first\n12. second\nand more", "a pump moves water uphill\n\n* first\n12. second\nand more"),
        (T.rejoin_wrapped_lines, "Ends here.\nNext: \nthen", "Ends here.\nNext:\nthen"),
        (T.drop_noise_lines, "One pump\n-=-=-\nleft <!-- over\nvalvesAndPumpsTogether\nTwo pumps", "One pump\nTwo pumps"),
        (T.rstrip_lines, "pump \t\n valve  ", "pump\n valve"),
        (T.normalize_whitespace, " one\t\ttwo    three\n\n\n\nfour ", "one two three\n\nfour"),
        (T.clean, None, ""),
        (T.clean, "", ""),
        (T.clean, "a\x0cb\x85c d", "a b c d"),
        (T.blocks, "\n pump \n\n \n valve\nand seal\n\n\n", ["pump", "valve\nand seal"]),
        (T.page_blocks, "One \r\n two\r\n\r\n\r\nThree", ["One two", "Three"]),
        (T.normalize_heading, "## C# lang  x", "Clang x"),
        (T.normalize_textbook_heading, "###   4   Pumps", "4 Pumps"),
        (T.sentences, "One here. Two there! three? Four", ["One here.", "Two there! three?", "Four"]),
        (T.sentences, "", []),
        (T.book_sentences, "Dr. Smith saw Fig. 3 by J. K. Lee.\nIt held. “Did it?” She left (at last.) Then cf. Müller et al. Next!", ["Dr. Smith saw Fig. 3 by J. K. Lee.", "It held.", "“Did it?”", "She left (at last.)", "Then cf. Müller et al. Next!"]),
        (T.book_sentences, " ", []),
        (lambda c: T.char_overlap(c, 0), "whole text", "whole text"),
        (lambda c: T.char_overlap(c, 8), "some longer text", "text"),
        (lambda c: T.char_overlap(c, 3), "abcdefgh", "fgh"),
    ],
)
def test_cleaning(one, f, given, wanted):
    assert one(f, given) == wanted


@pytest.mark.parametrize("block, wanted", [("### Pumps", True), ("Pumps and valves", True), ("Pumps <!-- x -->", False), ("3) a pump", False), ("* a valve", False), ("Does it end?", False), ("pumpsandvalvesandseals", False), ("pump " * 16, False), ("# " + "long " * 40, True), ("", False), ("AbcDef", False)])
def test_generic_headings(one, block, wanted):
    assert one(T.is_heading, block) is wanted


@pytest.mark.parametrize("block, wanted", [("# Pumps", True), ("ch. 7", True), ("CHAPTER 12 Pumps", True), ("3.2 Pumps, Valves (and Seals)", True), ("3.2 pumps", False), ("pump curves", False), ("# " + "x" * 140, False), ("", False)])
def test_textbook_headings(one, block, wanted):
    assert one(T.is_textbook_heading, block) is wanted


def test_nulls_stay_null(one):
    for f in (T.remove_html_comments, T.remove_image_lines, T.rstrip_lines, T.normalize_whitespace, T.space_markdown_headers, T.rejoin_wrapped_lines, T.drop_noise_lines, T.normalize_heading):
        assert one(f, None) is None
