"""Natural boundaries of the lower part of a window come before weaker cuts of the upper part."""

from lexigauge.llm.splitting import pieces


def test_lower_part_is_searched_before_spaces_and_hard_cuts():
    text = "One ends here. " + "x" * 100
    assert pieces(text, 40, 5)[0] == (0, 15)
    assert pieces("# a\n\nb c\n\n" + "word " * 40, 100, 5)[0] == (0, 10)
    assert pieces("a word " + "x" * 100, 40, 2)[0] == (0, 7)
    # A natural boundary of the upper part is taken before those of the lower part.
    assert pieces("a\n\n# b\n" + "x" * 20 + ". " + "y" * 60, 40, 5)[0] == (0, 29)
    # An end within the overlap cannot be used.
    assert pieces("Hi. " + "x" * 100, 40, 10)[0] == (0, 40)


def test_pieces_go_on():
    for text in ("a. " * 3 + "x" * 300 + ". " + "y" * 500, "x" * 50 + "\r\n" + "y" * 500):
        cuts = pieces(text, 60, 7)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(0 < b - a <= 60 for a, b in cuts)
        assert all(d[0] == c[1] - 7 and d[1] > c[1] for c, d in zip(cuts, cuts[1:]))
