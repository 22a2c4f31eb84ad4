"""Column expressions and small frame helpers, all JVM-side."""
