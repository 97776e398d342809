"""Column expressions: prompts, envelopes, reply parsing, attribute logic."""
