"""Texts that every operator has to take."""

ODD = [
    None,
    "",
    " ",
    "\n\t \x0b\x0c\r",
    "a",
    "one two three",
    "a" * 5000,
    "\x00\x01 abc\xad\x1f def",
    "naïve café – «été» ß ÀÉÎ \u3000 中文 한국어 😀 x²",
    "A  B\n\nA  B\r\nC\x85D\xa0E",
    "lone \ufffd and \U0010ffff end",
]
