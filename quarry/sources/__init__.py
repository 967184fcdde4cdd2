"""Sources: project files, the Apex lexer and parser, metadata formats."""
