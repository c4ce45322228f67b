"""Column builders: keys, references, values, vocabularies and scores. All stay in the JVM."""
