"""From SQL text to DataFrames: lexer, parser, predicates, lowering."""
