"""Reading tables and writing them: keyed, versioned, first-wins and compacted."""
