"""Part rows from word boxes."""

from tallyworks.operators import words as W


def word(text, x, y):
    return W.Word(text, float(x), float(y), float(x + max(24, 10 * len(text))), float(y + 20))


def test_reading_order_and_rows():
    ws = [word("c", 10, 200), word("b", 300, 8), word("a", 10, 12)]
    assert [w.text for w in W.reading_order(ws)] == ["a", "b", "c"]
    assert [[w.text for w in r] for r in W.rows(ws)] == [["a", "b"], ["c"]]


def test_part_numbers_in_three_ways():
    assert W.part_word([word("3x", 0, 0), word("3001", 40, 0)])[0] == "3001"
    assert W.part_word([word("970", 0, 0), word("c12", 40, 0)])[0] == "970c12"
    assert W.part_word([word("no", 0, 0)]) is None


def test_counts():
    assert [W.count(t) for t in ("4x", "x12", "ix", "(3x)", "7", "0x", "xx", "999x", "1000x", "|x", "xl")] == [4, 12, 1, 3, None, None, None, 999, None, 1, 1]
    assert [W.is_one(t) for t in ("@", "&#", ".", "x", "×", "xx", "x.", "a", "")] == [True, True, True, True, True, False, False, False, False]


def test_quantities():
    part = word("3001", 100, 100)
    assert W.quantity([part, word("4x", 100, 70), word("9x", 400, 70)], part) == 4
    assert W.quantity([part, word("6", 100, 70)], part) == 6
    assert W.quantity([part, word("5", 150, 100), word("x", 176, 100)], part) == 5
    assert W.quantity([part, word("5", 300, 100), word("x", 326, 100)], part) is None
    assert W.quantity([part, word("@", 100, 70)], part) == 1
    assert W.quantity([part], part) is None
    # the nearest count is the one nearest from left to right, whatever its height
    assert W.quantity([word("4x", 150, 98), word("8x", 100, 700), part], part) == 8
    # a count after the number; one too high or too far aside is none
    assert W.quantity([part, word("6", 150, 100)], part) == 6
    assert W.quantity([word("6", 100, -90), part], part) is None and W.quantity([word("6", 400, 60), part], part) is None
    assert W.quantity([word("@", 300, 100), part], part) is None and W.quantity([word("@", 60, 100), part], part) == 1


def test_items_of_a_page(spark):
    rows = [("m", 1, i, *w) for i, w in enumerate([word("2x", 100, 40), word("3001", 100, 70), word("Black", 100, 100), word("7x", 500, 40), word("3020b", 500, 70), word("Red", 500, 100)])]
    df = spark.createDataFrame(rows + [("m", 2, 0, "no parts", 0.0, 0.0, 1.0, 1.0), ("m", 3, 0, None, None, None, None, None)], "manual_id string, page_number int, word_index int, text string, x0 double, y0 double, x1 double, y1 double")
    out = [(r.part_number, r.quantity, r.color_name) for r in W.items(df).orderBy("page_number", "place").collect()]
    assert out == [("3001", 2, "Black"), ("3020b", 7, "Red")]
