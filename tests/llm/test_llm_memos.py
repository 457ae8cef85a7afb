"""What the encoder keeps in memory."""

import random

from pagework.llm import bpe
from pagework.llm.common import Recent


def test_a_memo_keeps_what_is_in_use():
    made = []
    memo = Recent(lambda key: made.append(key) or key * 2, 10)
    for i in range(1000):
        assert memo["often"] == "oftenoften" and memo[f"rare {i}"] == f"rare {i}" * 2
        assert len(memo) <= 10 and len(memo.older) <= 10
    assert made.count("often") == 1 and len(made) == 1001


def test_states_hold_no_finished_tokens():
    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"ab", b"abc", b"cd", b"bcd", b"da", b"abcda"):
        ranks[token] = len(ranks)
    machine = bpe.Transducer(ranks)
    random.seed(4)
    pieces = [bytes(random.choices(b"abcd", k=random.randint(1, 30))) for _ in range(300)]
    for piece in pieces:
        want = [ranks[t] for t in bpe.merge(piece, ranks)]
        assert machine.encode(piece) == want and list(machine.stream(piece)) == want
    goes_on = {key >> 8 for key in machine.child}
    for state in machine.states:
        assert all(h & bpe.LOW in goes_on for h in bpe.array("Q", state))
