"""Reading and writing datasets of images and box labels."""
