from weftline.operators import retrieval as R


def test_blocks_of_a_search_send_little():
    """With many queries they are dealt into more blocks, as each block of rows hands on k rows for every query of all."""
    n, k, spread = 600_000, 155, 600
    of_queries, of_rows = R.dealt(60_000, n, k, spread)
    sent = lambda a, b: b * 60_000 * (1 + k / 20) + a * n
    assert of_queries * of_rows >= spread and sent(of_queries, of_rows) < sent(4, spread) / 5
    assert R.dealt(10, 100, k, spread) == (1, 1) and R.dealt(0, 0, k, spread) == (1, 1)
    assert R.dealt(200, 10_000, 5, 12) == (1, 12)
