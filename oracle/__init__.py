"""Plain SQL for the registered queries, written in long form and by brute force."""
