"""Column functions: transforms, rules, keys and dates. All of them stay in the JVM."""
