"""Word lists, phrases and tables that results depend on."""

from __future__ import annotations

# Stop-words of the keyword search.
STOP_WORDS = (
    "đoạn", "video", "clip", "về", "một", "chương", "trình", "của", "tên", "là",
    "trong", "có", "thể", "thấy", "này", "đang", "đi", "tại", "thuộc", "tỉnh",
    "hãy", "tìm", "chính", "xác", "phân", "cảnh", "bắt", "đầu", "với", "hình",
    "ảnh", "sau", "đó", "tiếp", "theo", "người", "cần", "biết", "gồm", "các",
)

# Phrases that ask for text in a picture.
TEXT_CUES = (
    "dòng chữ", "biển hiệu", "bảng hiệu", "khẩu hiệu", "logo", "biển số", "biển báo",
    "bảng tên", "chữ viết", "tiêu đề", "bảng chữ", "tên gọi", "phông nền",
    "băng rôn", "banner", "poster", "nhãn dán", "ghi là", "có chữ", "đọc chữ",
    "thương hiệu", "nhãn hiệu", "tên quán", "tên đường", "slogan", "chữ in", "số áo",
    "hoành phi", "câu đối",
)

# Substitutions before translation, in order.
SUBSTITUTIONS = (
    ("vệ sinh (?:máy ảnh|ống kính|thiết bị|cảm biến|camera|lens)", "lau chùi bảo dưỡng máy ảnh"),
    ("măng tây", "asparagus"),
    ("múa lân", "lion dance performance"),
    ("con lân", "lion dance performer"),
    ("bọ cánh cứng", "beetle insect"),
    ("điêu khắc cát", "sand sculpture"),
    ("người đàn ông", "man"),
    ("người phụ nữ", "woman"),
)

# Openings that prompts leave out, and the prompts' frames.
PROMPT_OPENINGS = (
    "watch a video of", "watch the video of", "look for a video of", "find a video of", "find the scene of", "a scene of",
    "the clip is set in", "in the clip there is", "in the clip", "the clip depicts", "find exactly the short clip where",
    "this is an introduction to", "a piece of information about", "the scene begins with",
)
PROMPT_FRAMES = ("", "a photo of ", "a video scene showing ", "a high quality shot of ", "a close-up view of ")
SENTENCE_FRAMES = ("", "a photo of ", "a video scene of ")

# What marks a question in a query file.
QUESTION_MARKS = ("?", "câu hỏi", "cau hoi", "question", "q&a", "hỏi:", "là gì", "ở đâu", "thế nào", "màu gì", "bao nhiêu", "tên của", "ai là", "mấy câu thơ", "tiêu đề")
QUESTION_LINE_MARKS = ("?", "câu hỏi", "cau hoi", "question", "hỏi:")
QUESTION_OPENINGS = ("câu hỏi", "hỏi", "cho biết", "tìm xem")
QUESTION_LABELS = ("câu hỏi", "cau hoi", "question")
EVENT_LABEL = r"(?:sự kiện|su kien|event|bước|buoc|e\d+|\d+[.:)]|\(\d+\))"

# Phrases for which a question says "hình ảnh" instead, in order.
NEUTRAL_PHRASES = ("trong đoạn video có", "trong đoạn video", "đoạn video về", "đoạn video có", "đoạn video", "trong video", "video", "clip")
NEUTRAL = "hình ảnh"

# Answers.
UNKNOWN = "Không rõ"
NO_ANSWERS = ("không rõ", "chưa rõ", "none", "không có", "không tìm thấy")
REFUSALS = (
    "không rõ", "chưa rõ", "none", "không có", "không tìm thấy", "không thể",
    "tôi không", "xin lỗi", "hãy xin lỗi", "tôi không hiểu", "không hiểu",
    "không thấy", "không xác định", "xã a", "xã b", "món a", "món b", "người a", "người b", "công thức a",
)
ANSWER_OPENINGS = (
    r"(?:hình ảnh|đoạn video|video|clip)(?:\s+[^:–\-]+?)?\s*(?:là|đó là|chính là)?\s*[:\-\.]?\s*",
    r"(?:câu thơ|hai câu thơ|bài thơ|tiêu đề|tên(?:\s+của)?\s+[^:–\-]+?|đáp án|câu trả lời|kết quả)\s*(?:là|đó là|chính là)\s*[:\-\.]?\s*",
    r"(?:câu thơ|hai câu thơ|bài thơ|tiêu đề|tên(?:\s+của)?\s+[^:–\-]+?|đáp án|câu trả lời|kết quả)\s*[:\-\.]\s*",
    r"(?:món ăn|món|công thức|tiêu đề)(?:\s+này)?(?:\s+có)?(?:\s+tiêu đề|\s+tên)?\s*(?:là|đó là|chính là)\s*[:\-\.]?\s*",
    r"(?:xã|huyện|tỉnh|địa phương|nơi)(?:\s+này)?(?:\s+có)?(?:\s+tên)?\s*(?:là|đó là|chính là)\s*[:\-\.]?\s*",
    r"(?:dựa vào|nhìn vào|theo|quan sát)\s+hình ảnh\s*[,:]?\s*(?:thì|ta thấy|có thể thấy)?\s*",
    r"(?:trong hình|trên hình|trong ảnh|trên ảnh)\s*[,:]?\s*",
    r"(?:đó là|nó là|chính là|là)\s*[:\-\.]?\s*",
    r"đáp án\s*(?:là)?\s*[:\-\.]?\s*",
    r"trả lời\s*(?:là)?\s*[:\-\.]?\s*",
)
AGREEING = ("yes", "có", "đúng", "match")

# What a keyword of a query stands for among detected classes.
ENTITIES = {
    "xe đạp": ("Bicycle", "Vehicle"),
    "đua xe": ("Bicycle", "Wheel", "Helmet", "Sports equipment", "Person", "Clothing"),
    "tay đua": ("Bicycle", "Wheel", "Helmet", "Hat", "Clothing", "Person", "Sports equipment"),
    "flycam": ("Aircraft", "Vehicle"),
    "thuyền": ("Boat", "Watercraft", "Vehicle"),
    "ghe": ("Boat", "Watercraft", "Vehicle"),
    "chèo ghe": ("Boat", "Watercraft", "Person"),
    "tàu vũ trụ": ("Rocket", "Space vehicle", "Vehicle"),
    "người": ("Person",),
    "nam giới": ("Man", "Person"),
    "nữ giới": ("Woman", "Person"),
    "phụ nữ": ("Woman", "Person"),
    "đàn ông": ("Man", "Person"),
    "trẻ em": ("Girl", "Boy", "Person"),
    "cô gái": ("Girl", "Woman", "Person"),
    "chàng trai": ("Boy", "Man", "Person"),
    "con trai": ("Boy", "Man", "Person"),
    "con gái": ("Girl", "Woman", "Person"),
    "xe máy": ("Motorcycle", "Vehicle"),
    "ô tô": ("Car", "Vehicle"),
    "xe hơi": ("Car", "Vehicle"),
    "xe buýt": ("Bus", "Vehicle"),
    "xe tải": ("Truck", "Vehicle"),
    "máy bay": ("Airplane", "Aircraft", "Vehicle"),
    "trực thăng": ("Helicopter", "Aircraft", "Vehicle"),
    "tàu hỏa": ("Train", "Vehicle"),
    "tàu thủy": ("Boat", "Watercraft", "Vehicle"),
    "tên lửa": ("Rocket", "Space vehicle"),
    "phi hành gia": ("Person", "Suit", "Helmet"),
    "chó": ("Dog", "Animal", "Mammal", "Carnivore"),
    "mèo": ("Cat", "Animal", "Mammal", "Carnivore"),
    "ngựa": ("Horse", "Animal", "Mammal"),
    "bò": ("Cow", "Cattle", "Livestock", "Animal", "Mammal"),
    "dê": ("Goat", "Livestock", "Animal", "Mammal"),
    "cừu": ("Sheep", "Livestock", "Animal", "Mammal"),
    "hổ": ("Tiger", "Carnivore", "Animal", "Mammal"),
    "sư tử": ("Lion", "Carnivore", "Animal", "Mammal"),
    "voi": ("Elephant", "Animal", "Mammal"),
    "gấu": ("Bear", "Carnivore", "Animal", "Mammal"),
    "hươu": ("Deer", "Animal", "Mammal"),
    "chim": ("Bird", "Animal"),
    "cá": ("Fish", "Sea life", "Animal"),
    "cá mập": ("Shark", "Fish", "Sea life", "Animal"),
    "bạch tuộc": ("Sea life", "Animal"),
    "mực": ("Sea life", "Animal"),
    "bọ cánh cứng": ("Beetle", "Insect", "Animal"),
    "côn trùng": ("Insect", "Animal"),
    "bánh": ("Cake", "Baked goods", "Food"),
    "bánh rán": ("Doughnut", "Cake", "Pastry", "Food"),
    "chuối": ("Banana", "Fruit", "Food"),
    "táo": ("Apple", "Fruit", "Food"),
    "dâu": ("Fruit", "Food"),
    "dứa": ("Pineapple", "Fruit", "Food"),
    "nấm": ("Mushroom", "Vegetable", "Food"),
    "măng tây": ("Vegetable", "Food"),
    "thịt": ("Meat", "Beef", "Pork", "Food"),
    "gỏi cuốn": ("Spring roll", "Dish", "Food"),
    "pizza": ("Pizza", "Food"),
    "máy ảnh": ("Camera", "Camera lens", "Electronics"),
    "ống kính": ("Camera lens", "Camera"),
    "điện thoại": ("Cell phone", "Electronics"),
    "máy tính": ("Laptop", "Computer", "Electronics"),
    "tivi": ("Television", "Electronics"),
    "đàn": ("Musical instrument",),
    "nhạc cụ": ("Musical instrument",),
    "trống": ("Drum", "Musical instrument"),
    "kèn": ("Musical instrument",),
    "trượt ván": ("Skateboard", "Sports equipment"),
    "ván trượt": ("Skateboard", "Sports equipment"),
    "bóng đá": ("Sports ball", "Sports equipment"),
    "múa lân": ("Lion", "Dragon", "Costume"),
    "tượng": ("Sculpture", "Statue", "Art"),
    "điêu khắc": ("Sculpture", "Statue", "Art"),
    "hoa": ("Flower", "Rose", "Plant"),
    "cây": ("Tree", "Plant"),
    "sách": ("Book",),
    "kệ sách": ("Bookcase", "Furniture"),
    "bàn": ("Table", "Furniture"),
    "ghế": ("Chair", "Furniture"),
    "áo": ("Shirt", "Clothing"),
    "quần": ("Pants", "Clothing"),
    "nón": ("Hat", "Helmet", "Clothing"),
    "mũ": ("Hat", "Helmet", "Clothing"),
}

# Keywords that mean something else in some phrases, unless a cue stands by.
HOMONYMS = {
    "đàn": (("đàn hổ", "đàn dê", "đàn bò", "đàn chim", "người đàn ông", "đàn ong", "đàn cá"), ("chơi đàn", "gảy đàn", "tiếng đàn", "đàn guitar", "đàn piano", "đàn tranh", "nhạc cụ")),
    "tượng": (("tượng trưng", "tượng hình"), ("bức tượng", "tượng đài", "tạc tượng", "pho tượng")),
}

# Classes that an English query names by one word.
CLASSES = (
    "person", "man", "woman", "girl", "boy", "bicycle", "car", "motorcycle", "airplane", "bus",
    "train", "truck", "boat", "watercraft", "bench",
    "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "goat",
    "tiger", "lion", "carnivore", "mammal", "animal", "shark", "fish", "insect", "beetle",
    "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard",
    "kite", "skateboard", "surfboard", "bottle",
    "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "pizza", "donut", "cake", "food", "dessert", "pastry",
    "chair", "couch", "bed", "toilet", "laptop", "mouse", "remote",
    "keyboard", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock",
    "vase", "scissors", "toothbrush", "camera", "electronics",
    "rocket", "aircraft", "vehicle", "clothing", "suit", "helmet", "sculpture", "statue",
    "art", "sand", "flower", "plant", "rose", "mushroom", "vegetable", "meat", "beef", "pork", "fruit",
    "pineapple", "dish", "robot", "toy", "glass", "tableware", "wheel",
)

# Weights by how much a class says; any other weighs 3.5.
GENERIC_WEIGHT, PROP_WEIGHT, SUBJECT_WEIGHT = 0.5, 2.0, 3.5
GENERIC = (
    "person", "man", "woman", "girl", "boy", "human",
    "clothing", "shirt", "dress", "pants", "suit",
    "plant", "tree", "building", "window", "door", "wall", "sky", "floor", "ground", "road", "sand",
    "food", "animal", "vehicle",
)
PROPS = (
    "plate", "tableware", "tray", "bowl", "cup", "glass", "kitchen utensil", "bottle", "fork", "knife", "spoon",
    "table", "chair", "bookcase", "book", "bed", "couch", "furniture",
    "hat", "helmet", "backpack", "handbag", "tie", "costume", "box", "bag", "packaging",
    "vase", "clock", "toy",
)

#: What words of a query are known to show, for further prompts; none is given.
DOMAIN_PROMPTS: dict[str, str] = {}
