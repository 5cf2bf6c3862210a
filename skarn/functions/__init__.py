"""Column functions: everything here stays inside the JVM unless it says otherwise."""
