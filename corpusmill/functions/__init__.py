"""Column functions that stay inside the JVM, and the few Arrow-batched ones that cannot."""
