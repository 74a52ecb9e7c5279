"""Pairs of words that share no place and have equal polynomial hashes modulo 2^64: a Thue-Morse word and its complement."""


def _word(bits: int, flip: int) -> str:
    return "".join("ab"[i.bit_count() % 2 ^ flip] for i in range(1 << bits))


PAIRS = [(_word(n, 0), _word(n, 1)) for n in (10, 12)]
