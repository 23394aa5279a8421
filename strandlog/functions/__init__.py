"""Column functions: 64-bit hashing with wrap-around, codecs' arithmetic, deadlines, packed words, trace contexts."""
