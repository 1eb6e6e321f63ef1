"""Column expressions. Everything here stays inside the JVM unless it says otherwise."""
