"""From a bound query to DataFrame plans."""
