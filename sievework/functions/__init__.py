"""Column functions: text clean-up, rules, shingles, MinHash, prompts."""
