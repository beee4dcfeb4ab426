"""Reading landed catalogue extracts and stored metadata; writing results."""
