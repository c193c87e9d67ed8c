"""Column expressions: text, HTML and URL work that stays inside the JVM."""
