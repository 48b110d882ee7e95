"""Column functions: text normalisation, numbers in words, times and renderings."""
