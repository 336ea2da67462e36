"""Alphabets, code tables and wire constants of the sequence format."""

# Fixed values of the format: symbols and their digits, in matching order.
FOUR_BIT_SYMBOLS, FOUR_BIT_DIGITS = "UTACGRYKMSWBDHVN-", "44821965A3C7DEBF0"
FOUR_BIT_INVERSE = "-GCSTKYBARMVWDHN"
TWO_BIT_SYMBOLS, TWO_BIT_DIGITS, TWO_BIT_INVERSE = "TUCAG", "00123", "TCAG"
THREE_BIT_SYMBOLS, THREE_BIT_DIGITS, THREE_BIT_INVERSE = "TUCAGtucag", "0012344567", "TCAGtcag"
DEGENERATE = "RYSWKMBDHVN"
VALID = "ATUCGatucgRYSWKMBDHVNryswkmbdhvn -"
LEGACY_SYMBOLS, LEGACY_DIGITS, LEGACY_INVERSE = "UTACGRYKMSWBDHVN ", "44821965A3C7DEBF0", " GCSTKYBARMVWDHN"
LEGACY_DNA, LEGACY_RNA, LEGACY_END = "0F0", "F0F", "00F"
MAGIC, VERSION = b"FAST", 2
BLOCK_DESCRIPTION, BLOCK_TYPE, BLOCK_FOUR_BIT, BLOCK_NOTE = 0x01, 0x02, 0x03, 0x04
BLOCK_RUNS, BLOCK_TWO_BIT, BLOCK_THREE_BIT, BLOCK_LEGACY = 0x05, 0x06, 0x07, 0xFF
BLOCK_OF = {"2b": BLOCK_TWO_BIT, "3b": BLOCK_THREE_BIT, "4b": BLOCK_FOUR_BIT}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
