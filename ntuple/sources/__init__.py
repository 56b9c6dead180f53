"""Reading and writing rows, models and the compact text formats."""
