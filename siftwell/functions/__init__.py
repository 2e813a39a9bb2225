"""Column expressions: text, masks, redaction, keys and gates. Everything here stays in the JVM."""
