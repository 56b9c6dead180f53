"""Column helpers: literals, bindings, numeric constants and hash families."""
